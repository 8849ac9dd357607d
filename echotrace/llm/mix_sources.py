"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a 60-bit hash of its id and text; exact repeats are numbered, and
the number goes into the hash, so that no two rows need be taken alike.  Token sums per (source, hash bucket)
form a histogram; the running sum over the buckets shows in which bucket the
source's budget is crossed.  Only that boundary bucket is refined by the next
15 bits, until the full hash is fixed.  Rows below the threshold get one copy
more than the rest.  No row is ever sorted: windows run over histogram cells.

The sized rows (id, source, size, hash) are checkpointed once; each level reads
only them.  The histogram is map-side combined, the refinement joins on
(source, bucket), and the few rates per source are broadcast behind a count or
joined on (source, salt), so a source that holds a third of all rows never meets
in one task.

Defined results: a null text has size 0 and takes 0; a null source is a source
of its own (last in the weight order); an empty table gives an empty result; a
source without words has target 0.  A null id is hashed as the text ``null``, a null
text as an empty one.  Rows with equal id and text are told apart by their number, so
reruns take equally many of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echotrace.llm.common import cut, running_sums, word_count

HASH_BITS, LEVEL_BITS = 60, 15
SALTS = 64
#: Most sources (five numbers and a name each) sent to every task.
BROADCAST_SOURCES = 50_000


def _hash(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def row_hash() -> Column:
    return _hash(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))))


def repeats_apart(rows: DataFrame, h: str = "h") -> DataFrame:
    """``rows`` with the hashes of all but the first of equal ones replaced by hashes of theirs and their number.

    Only rows whose hash comes again are numbered: inside each partition by a window, behind the counts
    of the partitions before, so a group of any size never meets in one task.  Which of the equal
    rows has which number does not matter."""
    rows = rows.withColumn("__p", F.spark_partition_id())
    counts = rows.groupBy(h, "__p").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(F.col(h).alias("__d")).agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("__d")
    parts = counts.join(total, F.col(h) == F.col("__d"), "left_semi")
    before = parts.select(F.col(h).alias("__bh"), F.col("__p").alias("__bp"), (F.sum("n").over(
        Window.partitionBy(h).orderBy("__p")) - F.col("n")).alias("__before"))  # a row per partition that holds the hash
    numbered = (rows.join(before, (F.col(h) == F.col("__bh")) & (F.col("__p") == F.col("__bp")), "left")
                    .withColumn("__again", F.col("__before").isNotNull()))
    inside = Window.partitionBy(h, "__p").orderBy(F.lit(1))
    again = (numbered.where("__again").withColumn("__nr", F.col("__before") + F.row_number().over(inside) - 1)
                     .withColumn(h, F.when(F.col("__nr") > 0, _hash(F.concat_ws(":", h, "__nr"))).otherwise(F.col(h))))
    names = [c for c in rows.columns if c != "__p"]
    return numbered.where(~F.col("__again")).select(*names).unionByName(again.select(*names))


def sized_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): the only columns later steps need."""
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash().alias("h")))
    return repeats_apart(sized)


def water_fill(sources: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """(source, source_size) -> adds ``target``.

    ``target = least(max_repeat * source_size, level * weight)`` with the one
    level that spends the total.  Sorted by ``cap / weight``, the sources before
    the first that is not capped are full; the rest share what is left by weight.
    Seen from later sources the level only falls, so it is the largest that fits.
    Sources are ranked and summed by range partitions, however many there are.
    """
    by_name = [F.col("source").asc_nulls_last()]
    s = running_sums(sources, by_name, {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = (s.withColumn("weight", weight).withColumn("cap", F.lit(float(max_repeat)) * F.col("source_size"))
          .withColumn("ratio", F.col("cap") / F.col("weight")))
    s = cut(running_sums(s, [F.col("ratio").asc(), *by_name], {"capped": F.col("cap"), "weight_before": F.col("weight")}))
    whole = s.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights")).collect()[0]
    level = (F.lit(float(whole["total"] or 0)) - F.col("capped")) / (F.lit(float(whole["weights"] or 0)) - F.col("weight_before"))
    s = s.withColumn("level", level)
    best = s.agg(F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).alias("x")).collect()[0]["x"]
    s = s.withColumn("level", F.lit(best).cast("double"))
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, need) -> (source, threshold): rows with ``h < threshold`` sum up to
    ``need`` words as closely as whole hash values allow."""
    state = budgets.select("source", F.col("need").cast("double").alias("need"), F.lit(0).cast("long").alias("prefix"),
                           F.lit(0).cast("long").alias("size_at"))
    done = None
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        cells = sized
        if level:
            at = state.select(F.col("source").alias("s_source"), F.col("prefix").alias("s_prefix"))
            cells = sized.join(at, F.col("source").eqNullSafe(F.col("s_source"))
                               & (F.shiftright("h", shift + LEVEL_BITS) == F.col("s_prefix")), "left_semi")
        cells = (cells.groupBy("source", F.shiftright("h", shift).alias("bucket"))
                      .agg(F.sum("size").alias("cell")))
        run = Window.partitionBy("source").orderBy("bucket")
        before = (cells.withColumn("before", F.sum("cell").over(run) - F.col("cell"))
                       .select(F.col("source").alias("c_source"), "bucket", "cell", "before"))
        crossed = (state.join(before, F.col("source").eqNullSafe(F.col("c_source"))
                              & (F.col("before") + F.col("cell") > F.col("need")))
                        .groupBy("source")
                        .agg(F.min_by(F.struct("bucket", "cell", "before", "need"), "bucket").alias("b")))
        if level == 0:
            # a source whose words all fit has no boundary: every row is below the threshold
            done = state.join(crossed.select(F.col("source").alias("x")), F.col("source").eqNullSafe(F.col("x")),
                              "left_anti").select("source", F.lit(1 << HASH_BITS).cast("long").alias("threshold"))
        state = cut(crossed.select("source", (F.col("b.need") - F.col("b.before")).alias("need"),
                                   F.col("b.bucket").alias("prefix"), F.col("b.cell").alias("size_at")))
    closer = (F.col("need") * 2 >= F.col("size_at")).cast("long")
    return state.select("source", (F.col("prefix") + closer).alias("threshold")).unionByName(done)


def rates(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """(p_source, source_size, target, full, threshold) of every source: a row of it is taken ``full`` times, and
    once more when its hash lies below the threshold."""
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    shares = cut(water_fill(sums, weights, max_repeat)
                 .withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                      .otherwise(F.lit(0)).cast("long"))
                 .withColumn("need", F.col("target") - F.col("full") * F.col("source_size")))
    limit = thresholds(sized, shares).select(F.col("source").alias("t_source"), "threshold")
    return cut(shares.join(limit, F.col("source").eqNullSafe(F.col("t_source")), "left")
                     .select(F.col("source").alias("p_source"), "source_size", "target", "full", "threshold"))


def with_copies(rows: DataFrame, per_source: DataFrame, source: str = "source", h: str = "h") -> DataFrame:
    """``rows`` with the columns of ``per_source`` and ``copies``.

    Up to ``BROADCAST_SOURCES`` sources (counted) go to every task; more are
    joined by (source, salt).
    """
    same = F.col(source).eqNullSafe(F.col("p_source"))
    if per_source.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(per_source), same)
    else:
        salted = per_source.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.join(salted, same & (F.pmod(F.col(h), F.lit(SALTS)) == F.col("p_salt")))
    return joined.withColumn("copies", F.col("full") + (F.col(h) < F.col("threshold")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source, source_size, target, taken, copies.

    ``taken`` is the size times the copies of the row in the mix.
    """
    sized = cut(sized_rows(docs))
    return (with_copies(sized, rates(sized, weights, max_repeat))
            .select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                    "copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs`` (all columns), each as often as it is taken."""
    per_source = rates(cut(sized_rows(docs)), weights, max_repeat)
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), row_hash().alias("__h"), F.col("source").alias("__source"))
    chosen = with_copies(repeats_apart(keyed, "__h"), per_source, "__source", "__h")
    return (chosen.where(F.col("copies") > 0)
                  .select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nr"))
                  .select("__row.*"))


#: The same rows by plain sorting: running sums over rows in hash order.
MIX_SQL = """
WITH hashed AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h0
  FROM {documents}),
sized AS (
  SELECT doc_id, source, size, CASE WHEN nr = 0 THEN h0 ELSE CAST('0x' || substr(md5(h0 || ':' || nr), 1, 15) AS BIGINT) END AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY h0) - 1 AS nr FROM hashed)),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]
         AS weight, 3.0::DOUBLE * source_size AS cap
  FROM sums),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         coalesce(least(cap, max(CASE WHEN level <= cap / weight THEN level END) OVER () * weight), cap) AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_copies
  FROM targets),
cells AS (
  SELECT source, h, sum(size) AS cell, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) - sum(size) AS before
  FROM sized GROUP BY source, h),
crossing AS (
  SELECT c.source, min(c.h) AS h, arg_min(c.cell, c.h) AS cell,
         arg_min(target - full_copies * source_size - before, c.h) AS need
  FROM cells c JOIN budgets b ON c.source IS NOT DISTINCT FROM b.source
  WHERE before + cell > target - full_copies * source_size
  GROUP BY c.source),
copies AS (
  SELECT s.doc_id, s.size, s.source, b.source_size, b.target,
         b.full_copies + CASE WHEN x.h IS NULL OR s.h < x.h + (CASE WHEN x.need * 2 >= x.cell THEN 1 ELSE 0 END)
                              THEN 1 ELSE 0 END AS copies
  FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
  LEFT JOIN crossing x ON s.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM copies
"""
