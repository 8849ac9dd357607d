"""Importance resampling towards a target distribution, over hashed bags of n-grams.

Features are the runs of 1 to ``max_words`` consecutive words of a text, repeats
counted; a feature's bucket is the crc32 of its bytes modulo ``buckets``.  The
gain of a bucket is the log ratio of its smoothed shares in the target and in
the raw corpus, in thousandths; a text's weight is the sum over its features.
Adding standard Gumbel noise from a hash of the id and taking the highest scores
draws without replacement in proportion to the importance weights.

Each slice of texts interns its n-grams in an open-addressed NumPy table: the
xxhash64 of an n-gram's bytes says where it starts to probe, all occurrences probe
at once, those that find a free slot write themselves into it (the last one stays),
and a slot is one's own only if hash, length and every byte agree.  A slot holds
the bucket, taken once per distinct n-gram, and the count; the occurrences keep
their slot ids, through which counts are summed to buckets in the first pass and
gains are gathered and summed to texts in the second.

The corpus counts leave a task as one row for each bucket it met; only
``buckets`` sums and gains reach the driver.  Ranks come from a range sort and
counts per partition; no partition holds all rows.

Defined results: null and empty texts have no features and weight 0; without
target texts or documents the smoothing alone gives the gains; a null id is hashed
as the text ``null`` and stands behind others of its score; rows equal in score
and id are ordered by their number of features; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.arrow_text import plain_strings, raw_bytes, slices
from echotrace.llm.common import cut

#: Text bytes interned at once.
SLICE_BYTES = 1 << 20
#: Occurrences that probe together.
PROBE = 1 << 16
#: N-grams and words of more bytes are hashed and compared one by one.
LONG = 64

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, everything outside ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
#: The first k bytes of a little-endian lane.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


class ByteRanges:
    """Hashes and comparisons of ranges of one byte buffer."""

    def __init__(self, data: np.ndarray):
        """``data``: bytes, with eight spare ones at the end."""
        self.data = data
        self.view = memoryview(data)
        self.lane = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        self.half = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))

    def xxhash64(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The 64-bit xxhash (seed 0) of each range."""
        h = length.astype(np.uint64) + _P5
        for j in range(3):
            at = np.flatnonzero(length >= 8 * (j + 1))
            k = _rotated(self.lane[start[at] + 8 * j] * _P2, 31) * _P1
            h[at] = _rotated(h[at] ^ k, 27) * _P1 + _P4
        place, rest = start + (length & ~7), length & 7
        at = np.flatnonzero(rest >= 4)
        h[at] = _rotated(h[at] ^ (self.half[place[at]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        place, rest = place + (rest & 4), rest & 3
        for j in range(3):
            at = np.flatnonzero(rest > j)
            h[at] = _rotated(h[at] ^ (self.data[place[at] + j].astype(np.uint64) * _P5), 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
        long = np.flatnonzero(length >= 32)
        if len(long):
            import xxhash

            h[long] = [xxhash.xxh64_intdigest(self.view[a:a + n]) for a, n in zip(start[long].tolist(), length[long].tolist())]
        return h

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ranges of equal length at a and at b hold the same bytes."""
        same = np.ones(len(a), bool)
        rows, j = np.flatnonzero(a != b), 0
        for i in rows[length[rows] > LONG].tolist():
            n = int(length[i])
            same[i] = self.view[a[i]:a[i] + n] == self.view[b[i]:b[i] + n]
        rows = rows[length[rows] <= LONG]
        while len(rows):
            left = length[rows] - j
            differ = (self.lane[a[rows] + j] ^ self.lane[b[rows] + j]) & _FIRST[np.clip(left, 0, 8)]
            same[rows[differ != 0]] = False
            rows = rows[(differ == 0) & (left > 8)]
            j += 8
        return same


class InternTable:
    """Open-addressed table of byte ranges; a slot keeps the occurrence that claimed it."""

    def __init__(self, ranges: ByteRanges, start: np.ndarray, length: np.ndarray, capacity: int = 2 * PROBE,
                 hashes: np.ndarray | None = None):
        self.ranges, self.start, self.length = ranges, start, length
        self.hash = ranges.xxhash64(start, length) if hashes is None else hashes
        self.slot = np.zeros(len(start), np.int64)  # of every occurrence
        self.owner = np.full(capacity, -1, np.int64)
        n_owners = 0
        for lo in range(0, len(start), PROBE):
            hi = min(lo + PROBE, len(start))
            if 2 * (n_owners + hi - lo) > len(self.owner):
                self._grow(lo, 4 * (n_owners + hi - lo))
            n_owners += self._insert(np.arange(lo, hi))

    def _insert(self, rows: np.ndarray) -> int:
        """Finds or claims a slot for each row; returns the number of claimed ones."""
        mask = len(self.owner) - 1
        at, claimed = (self.hash[rows] & np.uint64(mask)).astype(np.int64), 0
        while len(rows):
            free = np.flatnonzero(self.owner[at] < 0)
            self.owner[at[free]] = rows[free]
            holder = self.owner[at]
            claimed += int((holder == rows).sum())
            same = (self.hash[holder] == self.hash[rows]) & (self.length[holder] == self.length[rows])
            check = np.flatnonzero(same)
            same[check] = self.ranges.equal(self.start[holder[check]], self.start[rows[check]], self.length[rows[check]])
            self.slot[rows[same]] = at[same]
            rows, at = rows[~same], (at[~same] + 1) & mask
        return claimed

    def _grow(self, done: int, least: int) -> None:
        """A larger table; the occurrences before ``done`` move with their owners."""
        before = self.slot[:done].copy()
        owners = self.owner[self.owner >= 0]
        moved = np.zeros(len(self.owner), np.int64)
        old = np.flatnonzero(self.owner >= 0)
        self.owner = np.full(1 << max(1, least - 1).bit_length(), -1, np.int64)
        self._insert(owners)
        moved[old] = self.slot[owners]
        self.slot[:done] = moved[before]

    def buckets(self, buckets: int) -> np.ndarray:
        """crc32 modulo ``buckets`` by slot; free slots have 0."""
        out = np.zeros(len(self.owner), np.int64)
        used = np.flatnonzero(self.owner >= 0)
        view, row = self.ranges.view, self.owner[used]
        out[used] = [zlib.crc32(view[a:a + n]) % buckets
                     for a, n in zip(self.start[row].tolist(), self.length[row].tolist())]
        return out

    def counts(self) -> np.ndarray:
        """Occurrences by slot."""
        return np.bincount(self.slot, minlength=len(self.owner))


def ngrams(texts: pa.Array, max_words: int) -> tuple[ByteRanges, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, start, length and text of every n-gram, words per text) of a string array without nulls."""
    raw, offsets = raw_bytes(texts)
    data = np.zeros(len(raw) + 8, np.uint8)
    np.take(_LOWER, raw, out=data[:len(raw)])
    dark = _IN_WORD[data[:len(raw)]]
    edge = np.zeros(len(raw) + 1, bool)  # between two texts
    edge[offsets] = True
    begins, ends = dark.copy(), dark.copy()
    begins[1:] &= ~dark[:-1] | edge[1:-1]
    ends[:-1] &= ~dark[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, offsets)
    words_of = np.diff(bounds)
    owner = np.repeat(np.arange(len(words_of)), words_of)
    if max_words == 1:
        return ByteRanges(data), start, end - start, owner, words_of
    # words one after another with a space behind each, so that an n-gram is one range
    size = end - start + 1
    place = np.cumsum(size) - size
    joined = np.full(int(size.sum()) + 8, 32, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(place, size)
    inner = step < np.repeat(size - 1, size)
    joined[:len(step)][inner] = data[(np.repeat(start, size) + step)[inner]]
    starts, lengths, owners = [], [], []
    for n in range(1, max_words + 1):
        first = np.flatnonzero(owner[:len(owner) - n + 1] == owner[n - 1:]) if len(owner) >= n else np.zeros(0, np.int64)
        starts.append(place[first])
        lengths.append(place[first + n - 1] + size[first + n - 1] - 1 - place[first])
        owners.append(owner[first])
    return ByteRanges(joined), np.concatenate(starts), np.concatenate(lengths), np.concatenate(owners), words_of


def bucket_counts(table: DataFrame, text: str = "text", max_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket int, n long): features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                ranges, start, length, _, _ = ngrams(plain_strings(part.column(text)), max_words)
                interned = InternTable(ranges, start, length)
                total += np.bincount(interned.buckets(buckets), weights=interned.counts(), minlength=buckets).astype(np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], ["bucket", "n"])

    return (table.select(text).mapInArrow(run, "bucket int, n long")
                 .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(raw: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Gain of each bucket from two tables of bucket counts (``buckets`` longs each reach the driver)."""
    counts = []
    for table in (raw, target):
        n = [0] * buckets
        for r in table.collect():
            n[r["bucket"]] = r["n"]
        counts.append(n)
    (s, t), (all_s, all_t) = counts, map(sum, counts)
    return np.array([math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
                     for b in range(buckets)], np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = "n_words long, n_features long, weight long, score long"


def scored(docs: DataFrame, gain: np.ndarray, text: str = "text", max_words: int = 1, seed: int = 0) -> DataFrame:
    """The columns of ``docs`` (but those named like results), with each text's words, features, weight and score."""
    ours, buckets = [f.split()[0] for f in SCORED.split(", ")], len(gain)
    carried = [c for c in docs.columns if c not in ours]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carried).schema) + SCORED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                ranges, start, length, owner, words_of = ngrams(plain_strings(part.column(text)), max_words)
                interned = InternTable(ranges, start, length)
                slot_gain = gain[interned.buckets(buckets)]
                running = np.concatenate([[0], np.cumsum(slot_gain[interned.slot])])
                weight = np.zeros(len(words_of), np.int64)
                # the n-grams of one length lie text by text
                edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
                np.add.at(weight, owner[edges[:-1]], np.diff(running[edges]))
                features = np.bincount(owner, minlength=len(words_of))
                noise = np.array([gumbel(i, seed) for i in part.column("doc_id").to_pylist()], np.int64)
                found = [words_of.astype(np.int64), features, weight, weight + noise]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + [pa.array(x) for x in found], carried + ours)

    return docs.select(*carried).mapInArrow(run, schema)


def drawn(found: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``found`` (doc_id, n_words, n_features, score, ...) with ``rank``: 1, 2, 3, ... of the ``percent`` of rows with
    at least ``min_words`` words that have the highest scores; null for the others."""
    found = cut(found)  # monotonic ids below are those of these very partitions
    able = found.where(F.col("n_words") >= min_words).withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("_tie")]
    n = able.count()
    placed = cut(able.repartitionByRange(*order).sortWithinPartitions(*order))
    spark = found.sparkSession
    sizes = {r["p"]: r["n"] for r in placed.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, rows = 0, []  # one row per partition
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    offsets = F.broadcast(spark.createDataFrame(rows or [(0, 0)], "_p int, _before long"))
    inner = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranked = (placed.withColumns({"_p": F.spark_partition_id(), "_at": inner}).join(offsets, "_p")
                    .withColumn("rank", F.col("_before") + F.col("_at") + 1).drop("_p", "_at", "_before", "_tie"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    rest = found.where((F.col("n_words") < min_words) | F.col("n_words").isNull()).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", max_words: int = 1,
             buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scores and draw of ``docs`` (doc_id, ``text``) towards the texts of ``target``; ``keep``: columns to carry along."""
    gain = gains(bucket_counts(docs, text, max_words, buckets), bucket_counts(target, target_text, max_words, buckets), buckets)
    kept = [c for c in keep if c not in ("doc_id", text)]
    found = scored(docs.select("doc_id", text, *kept), gain, text, max_words, seed)
    return drawn(found if text in keep else found.drop(text), percent, min_words)


def resample_sql(documents: str = "documents", target: str = "benchmark", buckets: int = 10_000, percent: int = 10,
                 min_words: int = 20, seed: int = 0) -> str:
    """DuckDB SQL of the draw over single words."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH crc_table AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([0,1,2,3,4,5,6,7],
           lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i::BIGINT) AS v
    FROM range(256) r(i))),
docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{word}') AS words
  FROM {documents}),
raw_words AS MATERIALIZED (SELECT n, unnest(words) AS w FROM docs),
target_words AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '{word}')) AS w
  FROM {target}),
vocabulary AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))),
                lambda j: ('0x' || substr(hex(encode(w)), 2 * j + 1, 2))::BIGINT),
                lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) % {buckets} AS bucket
  FROM (SELECT w FROM raw_words UNION SELECT w FROM target_words), crc_table),
s AS (SELECT bucket, count(*) AS n FROM raw_words JOIN vocabulary USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target_words JOIN vocabulary USING (w) GROUP BY bucket),
gain AS MATERIALIZED (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM raw_words) + {buckets})
                    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM target_words) + {buckets}))))::BIGINT AS g
  FROM range({buckets}) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weighed AS (
  SELECT raw_words.n, sum(g)::BIGINT AS weight FROM raw_words JOIN vocabulary USING (w) JOIN gain USING (bucket) GROUP BY raw_words.n),
noise AS (
  SELECT n, doc_id, len(words)::BIGINT AS n_features,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE)
               / 4294967296)))::BIGINT AS g
  FROM docs),
scored AS (
  SELECT n, doc_id, n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + g)::BIGINT AS score
  FROM noise LEFT JOIN weighed USING (n)),
ranked AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS r, count(*) OVER () AS able
  FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {percent} * able // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (n)"""
