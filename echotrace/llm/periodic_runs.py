"""Periodic runs of words, found online by dyadic square catching.

A run is a stretch of consecutive words with smallest period ``q`` that no
neighbouring word extends: words ``q`` apart are identical all through it.

Every completed, aligned block of ``2**k`` words is a catcher for squares whose
half is ``q`` words long, ``2**(k+1) <= q < 2**(k+2)``: the first half of such a
square holds a whole aligned block, and the block comes again ``q`` words later.
So each appended word advances, at every level, the comparison of the suffix of
``2**k`` words that it completes with just two live catchers (three at level 0,
where ``q = 1`` belongs too).  A suffix that equals its catcher is a caught
square.  Squares of one period at neighbouring catchers are one stretch;
comparisons by halves extend it to both sides, and stretches over the same words
merge into the run of the least period.  Suffixes are compared by 64-bit hashes
that double from level to level; every run is then checked word by word, and a
collision starts the slice again with another seed.

An appended slice of words advances all catchers of a level in one NumPy
operation; the words of many texts share a slice, kept apart by the text's number
in the hash of each word.

Defined results: a null or empty text has no words, no runs and an empty collapsed
text; repeated rows and null ids get rows of their own; an empty table gives an
empty result.  Each text is handled whole in one task (about 10 bytes a word and
level while it is worked on); nothing is shuffled, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.arrow_text import codes, plain_strings, slices, word_lists
from echotrace.llm.common import WORD

RUN = "struct<start:bigint,length:bigint,period:bigint>"
FOUND = f"n_words long, runs array<{RUN}>, collapsed string"
#: Text bytes appended at once.
SLICE_BYTES = 1 << 20

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the windows a and b side by side."""
    h = a * _MIX[0]
    h ^= h >> np.uint64(29)
    h += b * _MIX[1] + _MIX[2]
    h ^= h >> np.uint64(32)
    return h


class SquareCatchers:
    """Runs of a growing sequence of words (codes), possibly of several texts one after another.

    Squares are caught with ``append``; ``runs`` may be asked for at any time.
    Runs shorter than ``min_length`` words or ``min_exponent`` periods are no runs.
    """

    def __init__(self, min_exponent: int = 2, min_length: int = 2, seed: int = 0):
        if min_exponent < 2:
            raise ValueError("a run has two periods at least")
        self.min_exponent, self.min_length, self.seed = min_exponent, min_length, seed
        self.word, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.level: list[np.ndarray] = []  # hashes of the windows of 2**k words by their first word
        self.caught: list[list[tuple[np.ndarray, np.ndarray]]] = []  # (period, number of the catcher) by level

    def append(self, word: np.ndarray, text: np.ndarray | int = 0) -> None:
        """More words; ``text``: the number of each one's text, never falling."""
        self.word = np.concatenate([self.word, np.asarray(word, np.int64)])
        self.text = np.concatenate([self.text, np.broadcast_to(np.asarray(text, np.int64), len(word))])
        n = len(self.word)
        if not n:
            return
        longest = int(np.diff(np.flatnonzero(np.diff(self.text, prepend=self.text[0] - 1, append=self.text[-1] + 1))).max())
        k = 0
        while k == 0 or self.min_exponent << (k + 1) <= longest:
            if k == len(self.level):
                self.level.append(np.zeros(0, np.uint64))
                self.caught.append([])
            known, size = self.level[k], 1 << k
            if n - size + 1 > len(known):
                self._advance(k, np.arange(len(known), n - size + 1))
            k += 1

    def _advance(self, k: int, window: np.ndarray) -> None:
        """Compares the suffixes of 2**k words that start at ``window`` with the live catchers."""
        if k == 0:
            fresh = _joined(self.word[window].view(np.uint64) + np.uint64(self.seed), self.text[window].view(np.uint64))
        else:
            below = self.level[k - 1]
            fresh = _joined(below[window], below[window + (1 << (k - 1))])
        hashes = self.level[k] = np.concatenate([self.level[k], fresh]) if len(self.level[k]) else fresh
        nearest = (window - (2 << k)) >> k
        for catcher in (nearest, nearest - 1) if k else (nearest, nearest - 1, nearest + 1):
            start = catcher << k
            first = int(np.searchsorted(start, 0))
            hit = np.flatnonzero(hashes[start[first:]] == fresh[first:]) + first
            if len(hit):
                self.caught[k].append((window[hit] - start[hit], catcher[hit]))

    def _stretches(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(period, start, end) of the squares caught at level k, neighbours merged and extended to both sides."""
        none = np.zeros(0, np.int64)
        if not self.caught[k]:
            return none, none, none
        period, catcher = (np.concatenate(x) for x in zip(*self.caught[k]))
        n = len(self.word)
        key = np.sort(period * (n + 2) + catcher)
        head = np.flatnonzero(np.diff(key, prepend=-2) != 1)
        tail = np.append(head[1:], len(key)) - 1
        # a run of e periods holds so many whole blocks that come again
        long = tail - head + 1 >= 2 * self.min_exponent - 3 if k else tail - head + 1 >= self.min_exponent - 1
        first, last = key[head[long]], key[tail[long]]
        period = first // (n + 2)
        start, end = (first % (n + 2)) << k, ((last % (n + 2)) + 1) << k
        for j in range(k - 1, -1, -1):
            h, size = self.level[j], 1 << j
            at = np.maximum(start - size, 0)
            start = np.where((start >= size) & (h[at] == h[at + period]), start - size, start)
            fits = end + period + size <= n
            at = np.where(fits, end, 0)
            end = np.where(fits & (h[at] == h[np.where(fits, at + period, 0)]), end + size, end)
        return period, start, end + period

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, period) of all runs by start, then period; places in the whole sequence."""
        found = [self._stretches(k) for k in range(len(self.level))]
        period, start, end = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found) if found else ([], [], [])))
        long = end - start >= np.maximum(self.min_length, self.min_exponent * period)
        period, start, end = period[long], start[long], end[long]
        order = np.lexsort((period, end, start))
        period, start, end = period[order], start[order], end[order]
        least = np.ones(len(order), bool)
        least[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        period, start, end = period[least], start[least], end[least]
        order = np.lexsort((period, start))
        return start[order], end[order], period[order]

    def proven(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
        """Whether the words themselves bear out each run."""
        word, text, n = self.word, self.text, len(self.word)
        same = lambda i, j: word[i] == word[j] and text[i] == text[j]
        return all(
            text[a] == text[b - 1] and np.array_equal(word[a + q:b], word[a:b - q])
            and not (a and same(a - 1, a - 1 + q)) and not (b < n and same(b, b - q))
            for a, b, q in zip(start.tolist(), end.tolist(), period.tolist()))


def runs_of_slice(word: np.ndarray, words_of: np.ndarray, min_exponent: int, min_length: int,
                  ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of the runs of texts of ``words_of`` words each; places count over all texts."""
    text = np.repeat(np.arange(len(words_of)), words_of)
    seed = 0
    while True:
        catchers = SquareCatchers(min_exponent, min_length, seed)
        catchers.append(word, text)
        found = catchers.runs()
        if catchers.proven(*found):
            return found
        seed += 0x5851F42D


def _found(texts: pa.Array, min_exponent: int, min_length: int) -> list[pa.Array]:
    words, words_of = word_lists(texts)
    word, _ = codes(words)
    start, end, period = runs_of_slice(word, words_of, min_exponent, min_length)
    bounds = np.concatenate([[0], np.cumsum(words_of)])
    owner = np.searchsorted(bounds, start, side="right") - 1
    fields = [pa.array(x, pa.int64()) for x in (start - bounds[owner], end - start, period)]
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(words_of) + 1)), pa.int32()),
                                    pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    inside = np.zeros(len(word) + 1, np.int64)  # words behind the first period of a run
    np.add.at(inside, start + period, 1)
    np.add.at(inside, end, -1)
    kept = np.cumsum(inside)[:-1] == 0
    left = np.concatenate([[0], np.cumsum(kept)])[bounds]
    lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept)))
    return [pa.array(words_of.astype(np.int64)), runs, pc.binary_join(lists, " ")]


def find_runs(docs: DataFrame, text: str = "text", min_exponent: int = 2, min_length: int = 2) -> DataFrame:
    """The columns of ``docs`` but the text (and columns named like results), with all runs of the text by start,
    then period, and ``collapsed``: the words outside runs and each run's first period, joined by one space."""
    ours = [f.split()[0] for f in FOUND.split(", ")]
    carried = [c for c in docs.columns if c not in ours and c != text]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carried).schema) + FOUND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                found = _found(plain_strings(part.column(text)), min_exponent, min_length)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in carried] + found, carried + ours)

    return docs.select(*carried, text).mapInArrow(run, schema)


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) is divisible by 10, the words from some place on repeat with one period.

    With h the crc32 of the decimal id, g = floor(h/10) and n words, the tail starts
    at word g mod n and its period is 1 + floor((n - start) / (3 + g mod 8)).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"),
                        F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    n = F.size("w")
    start = (F.col("g") % n).cast("int")
    period = (1 + F.floor((n - start) / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil((n - start) / period).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", start + 1, period), times)), 1, n - start)
    planted = F.concat_ws(" ", F.slice("w", 1, start), tail)
    return split.select("doc_id", F.when(F.col("g").isNotNull() & (n > 0), planted).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """One row per text: number of runs, the longest one (ties: smallest start, then period), digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    some = F.size("runs") > 0
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("longest"),
                         F.when(some, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")).alias("lines"), "collapsed")
    length, period = F.col("longest.length"), -F.col("longest.period")
    return shown.select(
        "doc_id", "n_runs", (-F.col("longest.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
