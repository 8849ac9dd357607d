"""Shared pieces of the corpus operators: word pattern, table access, checkpoints.

Every operator takes the columns it names and ignores all others, so extra
columns (also ones named like an operator's own outputs) never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echotrace.session import cut_lineage, read_table, scratch_path

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

__all__ = ["WORD", "cut", "docs_of", "pages_of", "read_table", "running_sums", "scratch_path", "word_count"]


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in ``spark.checkpoint.dir``; survives lost executors."""
    return cut_lineage(df)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts as no word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with, for each name, the sum of its column over all rows before in ``order`` (0 for the first).

    Rows are range-partitioned and sorted; only one row of sums per partition reaches the driver."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))  # partitions now stay as they are
    placed = placed.withColumns({"__p": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    totals = placed.groupBy("__p").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).orderBy("__p").collect()
    before, rows = {name: 0 for name in sums}, []
    for r in totals:
        rows.append((r["__p"], *[float(before[name]) for name in sums]))
        before = {name: before[name] + (r[name] or 0) for name in sums}
    offsets = df.sparkSession.createDataFrame(rows or [(0, *[0.0] * len(sums))],
                                              "__q int, " + ", ".join(f"`__b_{name}` double" for name in sums))
    inside = Window.partitionBy("__p").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))  # one row per partition
    return joined.withColumns({name: F.col(f"__b_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()}
                              ).select(*df.columns, *sums)
