"""List-driven post filters.

A short reference list given as Python values becomes an ``OR`` of ``contains``
inside whole-stage codegen.  Lists given as DataFrames, of any length, are joined:

* the character 4-grams of all entries (shorter entries: the entry itself) go to the
  tasks as hashes, at most ``GRAM_CHUNK`` at once; longer lists take several passes;
* a first pass counts in how many texts each of them occurs, and every entry keeps
  its rarest one as signature (an entry with a gram that no text holds is out);
* a second pass lets a text leave its task only with signatures that it holds; they
  meet their entries in an equi-join and ``contains`` verifies.

Flags come back by the SHA-256 of the text, so null or repeated row keys matter
nothing, equal texts are verified once, and the rows are the same as with the
expression.  Filters that return two halves add one boolean flag column; ``split``
(U3) turns it into the kept and removed frames, so both halves come from one plan.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echotrace.functions.text import _c
from echotrace.session import cut_lineage

# Up to this many values the test is an OR chain; beyond, one array literal.
OR_CHAIN = 64
GRAM = 4
#: Gram hashes that go to the tasks at once (8 MB).
GRAM_CHUNK = 1_000_000
#: Bytes of text whose grams are in memory at once.
SLICE_CHARS = 1 << 20


def list_values(values: Iterable) -> list[str]:
    """Entries of a Python list as strings; nulls and empty cells (missing in a sheet) dropped."""
    if isinstance(values, DataFrame):
        raise TypeError("a DataFrame list is joined: use contains_flag")
    return [str(v) for v in (values or []) if v is not None and str(v) != ""]


def contains_any(col, values: Iterable[str]) -> Column:
    """J1/J2 as an expression: does the text contain any entry (substring)?
    Always a boolean (never null)."""
    vals = list_values(values)
    if not vals:
        return F.lit(False)
    if len(vals) <= OR_CHAIN:
        hit = reduce(or_, [F.contains(_c(col), F.lit(v)) for v in vals])
    else:
        hit = F.exists(F.array(*[F.lit(v) for v in vals]), lambda x: F.contains(_c(col), x))
    return F.coalesce(hit, F.lit(False))


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows with about ``SLICE_CHARS`` bytes of text; a longer text is a slice of its own."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_CHARS, side="right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def _grams(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all n-grams of code points, in order."""
    rows = texts.to_pylist()
    length = np.array([len(t) for t in rows], np.int64)
    points = np.frombuffer("".join(rows).encode("utf-32-le"), "<u4").astype(np.uint64)
    if len(points) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.full(len(points) - n + 1, n, np.uint64)
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += points[k:len(points) - n + 1 + k]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    row = np.repeat(np.arange(len(rows)), length)
    inside = row[:len(h)] == row[n - 1:]
    return row[:len(h)][inside], h[inside]


class _GramSet:
    """Sorted gram hashes with a bitmap in front, and how long the grams are."""

    def __init__(self, hashes: list[int], lengths: list[int]):
        self.sorted = np.unique(np.array(hashes, np.int64).view(np.uint64))
        self.lengths = sorted(set(lengths))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.sorted & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, place of the gram in ``sorted``) of the grams that the texts hold."""
        found = []
        for n in self.lengths:
            row, h = _grams(texts, n)
            maybe = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.sorted, h[maybe]), max(0, len(self.sorted) - 1))
            real = self.sorted[at] == h[maybe] if len(self.sorted) else np.zeros(len(maybe), bool)
            found.append(row[maybe[real]] * len(self.sorted) + at[real])
        key = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return key // max(1, len(self.sorted)), key % max(1, len(self.sorted))


def _gram_counts(grams: _GramSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(grams.sorted), np.int64)
        for batch in batches:
            for texts in _slices(batch.column("_t")):
                total += np.bincount(grams.hits(texts)[1], minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams.sorted[met].view(np.int64)), pa.array(total[met])], ["_g", "_df"])

    return run


def _gram_hits(grams: _GramSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _slices(batch.column("_t")):
                row, at = grams.hits(texts)
                yield pa.RecordBatch.from_arrays(
                    [texts.take(pa.array(row)), pa.array(grams.sorted[at].view(np.int64))], ["_t", "_g"])

    return run


def _entry_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_e) -> (_e, _g, _n): the distinct grams of each entry; of a short one itself."""
    for batch in batches:
        for texts in _slices(batch.column("_e")):
            size = np.minimum(np.array([len(t) for t in texts.to_pylist()]), GRAM)
            for n in range(1, GRAM + 1):
                own = np.flatnonzero(size == n)
                if len(own):
                    row, h = _grams(texts.take(pa.array(own)), n)
                    yield pa.RecordBatch.from_arrays(
                        [texts.take(pa.array(own[row])), pa.array(h.view(np.int64)), pa.array(np.full(len(row), n, np.int32))],
                        ["_e", "_g", "_n"])


def _gram_sets(grams: DataFrame) -> Iterator[_GramSet]:
    """The distinct (_g, _n) in sets of about ``GRAM_CHUNK``."""
    grams = cut_lineage(grams.select("_g", "_n").distinct())
    chunks = -(-grams.count() // GRAM_CHUNK)
    for c in range(chunks):
        rows = grams.where(F.pmod(F.col("_g"), F.lit(chunks)) == c).collect()
        yield _GramSet([r["_g"] for r in rows], [r["_n"] for r in rows])


def contains_flags(df: DataFrame, text: Column, lists: dict[str, DataFrame]) -> DataFrame:
    """``df`` with a boolean per list: the text of the row contains one of its entries (J1, J2 as a join).

    Null texts contain nothing; null and empty entries are dropped.  An empty list flags nothing."""
    entries = reduce(DataFrame.unionByName, [
        e.select(F.lit(name).alias("_l"), F.col(f"`{e.columns[0]}`").cast("string").alias("_e")) for name, e in lists.items()])
    entries = cut_lineage(entries.where(F.col("_e") != "").distinct())
    grams = cut_lineage(entries.select("_e").distinct().mapInArrow(_entry_grams, "_e string, _g long, _n int").distinct())
    texts = df.select(text.alias("_t")).where(F.col("_t").isNotNull())
    rarest = hits = None
    for some in _gram_sets(grams):
        part = texts.mapInArrow(_gram_counts(some), "_g long, _df long").groupBy("_g").agg(F.sum("_df").alias("_df"))
        rarest = part if rarest is None else rarest.unionByName(part)
    if rarest is None:
        return df.withColumns({name: F.lit(False) for name in lists})
    # an entry occurs only where its rarest gram does, and nowhere if one of its grams does not
    signed = (grams.join(rarest, "_g", "left").groupBy("_e")
                   .agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_g").alias("g"), F.col("_n").alias("n"))).alias("s"))
                   .where(F.col("s.df") > 0).select("_e", F.col("s.g").alias("_g"), F.col("s.n").alias("_n")))
    signed = cut_lineage(signed)
    for some in _gram_sets(signed):
        part = texts.mapInArrow(_gram_hits(some), "_t string, _g long")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return df.withColumns({name: F.lit(False) for name in lists})
    found = (hits.join(signed, "_g").where(F.contains("_t", F.col("_e"))).select(F.sha2("_t", 256).alias("_d"), "_e").distinct()
                 .join(entries, "_e").groupBy("_d").agg(*[F.max(F.col("_l") == name).alias(name) for name in lists]))
    rest = [c for c in df.columns if c not in lists]
    joined = df.select(*rest, F.sha2(text, 256).alias("_k")).join(found, F.col("_k") == F.col("_d"), "left")
    return joined.select(*rest, *[F.coalesce(name, F.lit(False)).alias(name) for name in lists])


def contains_flag(df: DataFrame, key: str, text: Column, entries: DataFrame, name: str) -> DataFrame:
    """``contains_flags`` for one list; rows are told apart by their text, so ``key`` may be null or repeated."""
    return contains_flags(df, text, {name: entries})


def list_flags(df: DataFrame, text: Column, lists: dict[str, object]) -> DataFrame:
    """A boolean per list: DataFrames are joined together, Python values become expressions."""
    joined = {name: v for name, v in lists.items() if isinstance(v, DataFrame)}
    df = contains_flags(df, text, joined) if joined else df
    return df.withColumns({name: contains_any(text, v) for name, v in lists.items() if name not in joined})


def list_flag(df: DataFrame, key: str, text: Column, values, name: str) -> DataFrame:
    """``contains_flag`` for a DataFrame list, the expression for Python values."""
    if isinstance(values, DataFrame):
        return contains_flag(df, key, text, values, name)
    return df.withColumn(name, contains_any(text, values))


def as_text(col) -> Column:
    """``str(cell)`` of a sheet cell: a missing cell prints as ``None``."""
    return F.coalesce(_c(col).cast("string"), F.lit("None"))


# ---------------------------------------------------------------- F1
def exclude_urls(df: DataFrame, excluded, url: str = "url", key: str = "idx") -> DataFrame:
    """Drop rows whose URL (``None`` when missing) contains an excluded entry."""
    return list_flag(df, key, as_text(url), excluded, "_excluded").where(~F.col("_excluded")).drop("_excluded")


# ---------------------------------------------------------------- F2
def keyword_present(keyword: str = "keyword", title: str = "title", content: str = "content") -> Column:
    """The row's own keyword occurs, case-insensitive, in title or content.
    A missing keyword matches nothing."""
    kw = F.lower(F.col(keyword))
    hit = F.contains(F.lower(as_text(title)), kw) | F.contains(F.lower(as_text(content)), kw)
    return F.coalesce(hit, F.lit(False))


def keep_keyword_posts(df: DataFrame, **cols) -> DataFrame:
    return df.where(keyword_present(**cols))


# ---------------------------------------------------------------- F3
def banned_term_flag(rules: Sequence[tuple[str, str]]) -> Column:
    """True when any (column, regex term) matches case-insensitively; missing
    cells are treated as empty text."""
    flag = F.lit(False)
    for col, term in rules:
        flag = flag | F.coalesce(F.col(col), F.lit("")).rlike("(?iu)" + term)
    return flag


def drop_banned(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    return df.where(~banned_term_flag(rules))


# ---------------------------------------------------------------- F4
def untrusted_flag(untrusted_phrases, untrusted_domains, trusted_domains, content: str = "content") -> Column:
    """Remove when (an untrusted phrase or domain is in the body) and no trusted
    domain is; Python lists (``plans.clean`` also takes DataFrames)."""
    body = as_text(content)
    return ((contains_any(body, untrusted_phrases) | contains_any(body, untrusted_domains))
            & ~contains_any(body, trusted_domains))


# ---------------------------------------------------------------- F5
def ending_flag(ending: str, exception: str, keep_term: str,
                title: str = "title", content: str = "content") -> Column:
    """Removal mask of the ending filter: in title and in body the ending is
    absent or its exception present, and neither has the keep term."""
    def has(c, s):
        return F.coalesce(F.contains(F.col(c), F.lit(s)), F.lit(False))
    return ((~has(title, ending) | has(title, exception))
            & (~has(content, ending) | has(content, exception))
            & ~has(title, keep_term) & ~has(content, keep_term))


# ---------------------------------------------------------------- U3
def split(df: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """Disjoint, complete halves by a boolean flag: (kept, removed)."""
    return df.where(~F.col(flag)).drop(flag), df.where(F.col(flag)).drop(flag)


# ---------------------------------------------------------------- A9
def non_null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: non-null count per column (``DataFrame.count()`` of pandas)."""
    cols = list(cols or df.columns)
    return df.agg(*[F.count(F.col(c)).alias(c) for c in cols])
