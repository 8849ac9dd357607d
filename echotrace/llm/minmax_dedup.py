"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

Each permutation of the shingle hashes gives two values, its minimum and its
maximum, so half the hash evaluations fill the signature.  Values are banded:
documents that agree on all values of a band share a bucket.  With four rows and
28 bands a pair at similarity 0.8 shares no bucket with probability 4e-7.

Steps (texts move only for documents that share a bucket):

1. one pass over the texts: shingle count, set fingerprint, band keys, sketch;
2. documents with equal sets become one class, ids are aggregated map-side;
3. each bucket names a leader; pairs (leader, member) that pass a size bound and
   a sketch bound are confirmed on the full sets, and linked classes merged;
4. buckets that still hold several components are finished exactly: members
   outside the bucket's largest component are compared with every member of
   another component, in blocks of a bounded number of sets, and only confirmed
   links leave a task.  Components are merged again.

No step lists the pairs of a group, and a bucket that holds a third of all rows
is met by leaders first and by blocks then.

Defined results: documents without words (null, empty, white space) have an empty
set, are linked with nothing and kept; one to three words are one shingle; rows
with the same id and text count as one document, of which ``first_row`` marks one;
a null id takes part and sorts last; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.arrow_text import codes, plain_strings, slices, word_lists
from echotrace.llm.common import cut
from echotrace.llm.components import components

#: Words of a shingle, if the caller names no other number.
SHINGLE = 4
THRESHOLD = 80  # per cent
ROWS, BANDS = 4, 28
SKETCH_WORDS = 4
#: Sketch bits of a pair at the threshold differ in 22 of 224 on average (deviation 5.4); six deviations are allowed.
SKETCH_BITS = 55
#: Sets per side of a block.
BLOCK = 400
#: Most ids (two longs each) sent to every task to pick the texts of candidates; more are joined by shuffle.
BROADCAST_IDS = 500_000
LAST_ID = (1 << 63) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    n = ROWS * BANDS // 2
    seeds = _mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 64-bit shingle hashes of all texts in order, shingles per text) of strings without nulls."""
    words, words_of = word_lists(pc.ascii_lower(texts))
    code, vocabulary = codes(words)
    n = len(texts)
    if not len(code):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    word = pd.util.hash_array(np.array(vocabulary.to_pylist(), dtype=object), categorize=False)[code]
    first = np.cumsum(words_of) - words_of
    size = np.where(words_of >= shingle, words_of - shingle + 1, (words_of > 0).astype(np.int64))
    owner = np.repeat(np.arange(n), size)
    nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    at = first[owner] + nth
    value = np.full(len(at), 0x51ED270B, np.uint64)
    for k in range(shingle):
        inside = k < words_of[owner]
        step = _mix(value * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(at + k, len(word) - 1)])
        value = np.where(inside, step, value)
    dense, _ = codes(value)
    in_text, _ = codes(dense * n + owner)
    highest = np.maximum.accumulate(np.concatenate([[-1], in_text]))[:-1]
    new = in_text > highest
    return value[new], np.bincount(owner[new], minlength=n).astype(np.int64)


def signatures(values: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints n x 2, band keys n x BANDS, sketch n x 4) of the texts with a set (size > 0)."""
    start = np.cumsum(size) - size
    factor, offset = _permutations()
    signature = np.empty((len(size), 2 * len(factor)), np.uint64)
    for i, (a, b) in enumerate(zip(factor, offset)):
        moved = (values ^ b) * a
        moved ^= moved >> np.uint64(32)
        moved *= np.uint64(0xD6E8FEB86659FD93)
        signature[:, 2 * i] = np.minimum.reduceat(moved, start)
        signature[:, 2 * i + 1] = np.maximum.reduceat(moved, start)
    prints = np.stack([np.add.reduceat(_mix(values), start), np.add.reduceat(_mix(values ^ np.uint64(0xABCDEF)), start)], axis=1)
    keys = np.empty((len(size), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(size), band + 1, np.uint64)
        for r in range(ROWS):
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + signature[:, band * ROWS + r])
        keys[:, band] = key
    hashed = _mix(signature)
    per_word = signature.shape[1] * 2 // SKETCH_WORDS // 2
    sketch = np.zeros((len(size), SKETCH_WORDS), np.uint64)
    for j in range(signature.shape[1]):
        sketch[:, j // per_word] |= (hashed[:, j] & np.uint64(3)) << np.uint64(2 * (j % per_word))
    return prints, keys, sketch


def described(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: uid, doc_id, text_hash, n_shingles, f1, f2, keys, sketch."""
    chosen = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                values, size = shingle_sets(plain_strings(part.column("text")), shingle)
                full = np.flatnonzero(size)
                prints, keys, sketch = np.zeros((n, 2), np.uint64), [None] * n, [None] * n
                if len(full):
                    prints[full], some_keys, some_sketch = signatures(values, size[full])
                    for i, k, s in zip(full.tolist(), some_keys.astype(np.int64), some_sketch.astype(np.int64)):
                        keys[i], sketch[i] = k, s
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(uid, uid + n)), part.column("doc_id"), part.column("text_hash"), pa.array(size),
                     pa.array(prints[:, 0].astype(np.int64)), pa.array(prints[:, 1].astype(np.int64)),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.list_(pa.int64()))],
                    ["uid", "doc_id", "text_hash", "n_shingles", "f1", "f2", "keys", "sketch"])
                uid += n

    return chosen.mapInArrow(run, "uid long, doc_id long, text_hash long, n_shingles long, f1 long, f2 long, "
                                  "keys array<long>, sketch array<long>")


def _sets_of(docs: DataFrame, needed: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, set): full sorted sets of the classes in ``needed`` (node, doc_id, text_hash)."""
    wanted = needed.select("node", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"))
    if needed.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = (docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
                .join(wanted, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
                .select("node", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, size = shingle_sets(plain_strings(part.column("text")), shingle)
                ends = np.cumsum(size)
                sets = [np.sort(values[e - n:e]).tobytes() for e, n in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    return rows.mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def similar(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union, for sorted arrays without repeats."""
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return 100 * both >= threshold * (len(a) + len(b) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar."""
    left = sets.select(F.col("node").alias("na"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("nb"), F.col("set").alias("sb"))
    joined = (pairs.join(right, F.col("b") == F.col("nb")).select("a", "b", "sb")
                   .join(left, F.col("a") == F.col("na")).select("a", "b", "sa", "sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold)
                    for x, y in zip(batch.column("sa"), batch.column("sb"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _near(n: str, m: str, threshold: int):
    """Size bound: the smaller set must have the threshold's share of the larger."""
    return 100 * F.least(n, m) >= threshold * F.greatest(n, m)


def _block_links(x: list[tuple], y: list[tuple], threshold: int) -> list[tuple[int, int]]:
    """Links (component, component) between sets of both sides; items are (component, sorted set)."""
    flat = np.concatenate([s for _, s in y])
    owner = np.repeat(np.arange(len(y)), [len(s) for _, s in y])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    y_size, y_comp = np.array([len(s) for _, s in y]), np.array([c for c, _ in y])
    out = set()
    for comp, s in x:
        lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        at = np.arange(total) + np.repeat(lo - (np.cumsum(n) - n), n)
        both = np.bincount(owner[at], minlength=len(y))
        hit = (100 * both >= threshold * (len(s) + y_size - both)) & (y_comp != comp)
        out.update((comp, int(c)) for c in np.unique(y_comp[hit]))
    return list(out)


def _finished(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between components within buckets: ``members`` has key, node, comp."""
    sized = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    facts = (sized.groupBy("key").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("total"),
                                      F.max(F.struct("n", "comp")).alias("top"))
                  .where(F.col("comps") > 1)
                  .select(F.col("key").alias("k"), F.col("top.comp").alias("top"),
                          F.ceil((F.col("total") - F.col("top.n")) / BLOCK).alias("x_blocks"),
                          F.ceil(F.col("total") / BLOCK).alias("y_blocks")))
    open_ = members.join(facts, F.col("key") == F.col("k")).select("key", "node", "comp", "top", "x_blocks", "y_blocks")
    spread = F.xxhash64("node", F.lit(5))
    y = open_.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("x_blocks") - 1)).alias("xb"),
                     F.pmod(spread, "y_blocks").alias("yb"), F.lit(1).alias("side"), "node", "comp")
    x = open_.where(F.col("comp") != F.col("top")).select(
        "key", F.pmod(spread, "x_blocks").alias("xb"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("y_blocks") - 1)).alias("yb"), F.lit(0).alias("side"), "node", "comp")
    blocks = (x.unionByName(y).withColumnRenamed("node", "n").join(sets, F.col("n") == F.col("node"))
               .select(F.xxhash64("key", "xb", "yb").alias("block"), "key", "xb", "yb", "side", "comp", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def links() -> pa.RecordBatch:
            found = _block_links(*sides, threshold) if sides[0] and sides[1] else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for key, xb, yb, side, comp, s in zip(*[batch.column(c).to_pylist() for c in ("key", "xb", "yb", "side", "comp")],
                                                  batch.column("set")):
                if (key, xb, yb) != now:
                    if now is not None:
                        yield links()
                    now, sides = (key, xb, yb), ([], [])
                sides[side].append((comp, np.frombuffer(s.as_py(), np.uint64)))
        if now is not None:
            yield links()

    return (blocks.repartition("block").sortWithinPartitions("block", "key", "xb", "yb", "side")
                  .drop("block").mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_hash, n_shingles, component_id, kept, first_row."""
    rows = cut(described(docs, shingle))
    order_id = F.coalesce("doc_id", F.lit(LAST_ID))
    first = F.min(F.struct(order_id.alias("order_id"), F.col("uid")))
    classes = cut(rows.where(F.col("n_shingles") > 0).groupBy("f1", "f2").agg(first.alias("head"))
                      .select("f1", "f2", F.col("head.uid").alias("node"), F.col("head.order_id").alias("order_id")))
    heads = rows.join(classes.select("node"), F.col("uid") == F.col("node"), "left_semi")
    keyed = heads.select(F.explode("keys").alias("key"), F.col("uid").alias("node"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("key")
    in_bucket = keyed.join(shared, "key", "left_semi")
    facts = heads.select(F.col("uid").alias("h"), F.col("n_shingles").alias("n"), "sketch")
    members = cut(in_bucket.join(facts, F.col("node") == F.col("h")).select("key", "node", "n", "sketch"))
    candidates = members.select("node").distinct()
    needed = cut(rows.join(candidates, F.col("uid") == F.col("node")).select("node", "doc_id", "text_hash"))
    sets = cut(_sets_of(docs, needed, shingle))

    # a leader per bucket, another order in every bucket
    leader = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("l"),
                                                       F.col("n").alias("ln"), F.col("sketch").alias("ls"))).alias("x"))
    leader = leader.select(F.col("key").alias("lk"), "x.l", "x.ln", "x.ls")
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("ls")[i])) for i in range(1, SKETCH_WORDS)),
                F.bit_count(F.col("sketch")[0].bitwiseXOR(F.col("ls")[0])))
    pairs = (members.join(leader, F.col("key") == F.col("lk"))
                    .where((F.col("node") != F.col("l")) & _near("n", "ln", threshold) & (apart <= SKETCH_BITS))
                    .select(F.least("node", "l").alias("b"), F.greatest("node", "l").alias("a")).distinct())
    stars = components(_confirmed(pairs, sets, threshold))

    root = stars.select(F.col("node").alias("rn"), "root")
    labelled = cut(members.join(root, F.col("node") == F.col("rn"), "left")
                          .select("key", "node", F.coalesce("root", "node").alias("comp")))
    merged = components(_finished(labelled, sets, threshold))

    joined = merged.select(F.col("node").alias("mn"), F.col("root").alias("top"))
    nodes = (classes.join(root, F.col("node") == F.col("rn"), "left")
                    .withColumn("comp", F.coalesce("root", "node"))
                    .join(joined, F.col("comp") == F.col("mn"), "left")
                    .select("f1", "f2", "node", "order_id", F.coalesce("top", "comp").alias("comp")))
    nodes = cut(nodes)
    heads_of = nodes.groupBy("comp").agg(F.min(F.struct("order_id", "node")).alias("head")).select(
        F.col("comp").alias("hc"), F.col("head.order_id").alias("component_id"), F.col("head.node").alias("head_uid"))
    final = cut(nodes.join(heads_of, F.col("comp") == F.col("hc"))
                     .select(F.col("f1").alias("c1"), F.col("f2").alias("c2"), "component_id", "head_uid"))
    out = rows.select("uid", "doc_id", "text_hash", "n_shingles", "f1", "f2").join(
        final, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")) & (F.col("n_shingles") > 0), "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(
        F.when(F.col("component_id") == LAST_ID, F.lit(None)).otherwise(F.col("component_id")))
    return out.select("doc_id", "text_hash", "n_shingles", own.alias("component_id"),
                      own.eqNullSafe(F.col("doc_id")).alias("kept"),
                      ((F.col("n_shingles") == 0) | (F.col("uid") == F.col("head_uid"))).alias("first_row"))


def one_of_each_group(docs: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand first in their group; a row listed twice stays once."""
    found = near_duplicates(docs, threshold, shingle).where("first_row")
    keys = found.select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("__doc"), F.col("text_hash").alias("__hash")).distinct()
    keyed = docs.withColumn("__doc", F.coalesce("doc_id", F.lit(LAST_ID))).withColumn("__hash", F.xxhash64("text"))
    # both steps deal the texts by the same two columns: they move once
    return keyed.join(keys, ["__doc", "__hash"], "left_semi").dropDuplicates(["__doc", "__hash"]).select(*docs.columns)


#: The same rows by joining all shingles and closing the links.
NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4
           THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS s FROM w),
one AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM one a JOIN one b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
          WHERE 100 * c >= 80 * (len(a.s) + len(b.s) - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, both_ways.y FROM reach JOIN both_ways ON both_ways.x = reach.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id, r.c = s.doc_id AS kept
FROM sets s JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id
"""
