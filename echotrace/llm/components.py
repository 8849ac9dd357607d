"""Connected components of an edge table by alternating large and small stars.

Each round every node hands its larger (then its smaller) neighbours to the
least node it knows; the edges end as stars around the least node of each
component after a logarithmic number of rounds.  A hub with very many edges only
meets as map-side combined minima and in an equi-join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) -> (node, root): root is the least node of the component; isolated nodes are absent."""
    now = cut(edges.where(F.col("a") != F.col("b"))
              .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
        large = (now.select(F.col("v").alias("u"), F.col("u").alias("v"))  # neighbours larger than u
                    .join(least, F.col("u") == F.col("mu")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), "m")
        small = (large.join(lowest, F.col("u") == F.col("mu"))
                      .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                      .select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct())
        now = cut(small)
        facts = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).collect()[0]
        if facts == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = facts
