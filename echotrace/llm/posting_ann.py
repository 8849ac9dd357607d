"""Nearest neighbours by balanced posting lists and a centroid graph.

The index is fitted on a bounded sample: the sample is halved by two-means until
no list holds more than its share, which keeps the lists balanced, and the
centroids get a graph of near links.  Every row of the table is then indexed:
a graph search finds its nearest centroids, and a vector near a border is
replicated to each list whose distance is within ``replica_ratio`` of the
closest (at most ``MAX_REPLICAS`` lists, and none that a chosen centroid shields).

A query searches the graph and reads the lists within a distance ratio of the
closest one.  The ratio is the smallest of a grid that reaches ``target_recall``
by brute force on the sample, which is harder than the whole table: there the
neighbours lie closer.  Lists and queries meet in blocks: a list with many
vectors is split by vector, one with many queries by query, so a vector or a
query that is very common never gathers in one task.  The nearest lists are read
first; farther rounds return only what beats the ``k``-th score found so far, so
few rows leave a block.  The merge drops replicas.

The largest inner product is searched as the nearest point: each vector gets one
more component that brings all to the same length.

Defined results: vectors that are null, zero, hold null or non-finite components,
have a null id, or not the usual number of components take no part; equal rows
count once, and of different vectors with one id the least (component by component); a query with fewer candidates than ``k`` in its lists is searched
again in all lists; ties go to the smaller id; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echotrace.llm.common import cut

#: Bounds of what is fitted, and so of what reaches the driver or is sent to tasks.
SAMPLE_ROWS, MAX_LISTS = 20_000, 4096
LIST_ROWS = 200
LINKS = 24
MAX_REPLICAS = 3
#: Lists a query reads first, and how much farther each later round reaches.
FIRST_LISTS, WIDENING = 8, 8
BLOCK_VECTORS, BLOCK_QUERIES = 4000, 500
RATIOS = (1.0, 1.01, 1.02, 1.03, 1.04, 1.05, 1.06, 1.08, 1.1, 1.12, 1.15, 1.2, 1.3, 1.5, 2.0)


def usable(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>): the rows that take part, each once."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0.0))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["d"] if usual else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


@dataclass(frozen=True)
class Index:
    """Centroids (lists x dimension + 1), their links, and the radius all vectors are lifted to."""

    centroids: np.ndarray
    links: np.ndarray
    radius: float
    ratio: float
    width: int  # lists a query may look at before the ratio prunes them

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.radius ** 2 - (x ** 2).sum(axis=1), 0.0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def lift_queries(self, q: np.ndarray) -> np.ndarray:
        scaled = q * (self.radius / np.sqrt((q ** 2).sum(axis=1)))[:, None]
        return np.concatenate([scaled, np.zeros((len(q), 1))], axis=1)

    def nearest(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Graph search: (lists, distances) of about ``width`` nearest centroids of each point, nearest first."""
        n_lists = len(self.centroids)
        width = min(width, n_lists)
        lists, far = np.empty((len(points), width), np.int64), np.empty((len(points), width))
        for lo in range(0, len(points), 256):
            lists[lo:lo + 256], far[lo:lo + 256] = self._beam(points[lo:lo + 256], width)
        return lists, far

    def _distance(self, points: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.centroids[lists] - points[:, None, :]) ** 2).sum(axis=2))

    def _beam(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, n_lists = len(points), len(self.centroids)
        rows = np.arange(n)[:, None]
        entries = np.unique(np.linspace(0, n_lists - 1, max(width, min(n_lists, 8))).astype(np.int64))
        pool = np.tile(entries, (n, 1))
        far = self._distance(points, pool)
        seen = np.zeros((n, n_lists + 1), bool)
        seen[:, entries] = True
        open_ = np.ones(pool.shape, bool)
        while True:
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            pool, far, open_ = pool[rows, order], far[rows, order], open_[rows, order]
            pick = np.argmax(open_, axis=1)
            active = open_[rows[:, 0], pick]
            if not active.any():
                return pool, far
            open_[rows[:, 0], pick] = False
            more = np.where(active[:, None], self.links[pool[rows[:, 0], pick]], n_lists)
            more = np.where(seen[rows, more], n_lists, more)
            seen[rows, more] = True
            seen[:, n_lists] = False
            real = more < n_lists
            found = np.where(real, self._distance(points, np.minimum(more, n_lists - 1)), np.inf)
            pool, far = np.concatenate([pool, np.minimum(more, n_lists - 1)], axis=1), np.concatenate([far, found], axis=1)
            open_ = np.concatenate([open_, real], axis=1)

    def homes(self, points: np.ndarray, replica_ratio: float) -> list[list[int]]:
        """Lists of each point: the nearest, and near ones that no chosen centroid shields."""
        lists, far = self.nearest(points, 4 * MAX_REPLICAS)
        near = far <= replica_ratio * far[:, :1]
        out = []
        for row, d, ok in zip(lists, far, near):
            chosen = [int(row[0])]
            for j in range(1, len(row)):
                if not ok[j] or len(chosen) == MAX_REPLICAS:
                    break
                gaps = np.sqrt(((self.centroids[chosen] - self.centroids[row[j]]) ** 2).sum(axis=1))
                if (gaps > d[j] * 0.5).all():
                    chosen.append(int(row[j]))
            out.append(chosen)
        return out

    def probes(self, points: np.ndarray) -> list[list[int]]:
        lists, far = self.nearest(points, self.width)
        ok = far <= self.ratio * far[:, :1]
        return [row[k].tolist() for row, k in zip(lists, ok)]


def _halve(x: np.ndarray, limit: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of a balanced tree of two-means splits."""
    done, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        y = x[part]
        if len(part) <= limit:
            done.append(y.mean(axis=0))
            continue
        centre = y[rng.choice(len(part), 2, replace=False)]
        left = np.zeros(len(part), bool)
        for _ in range(8):
            lean = ((y - centre[0]) ** 2).sum(axis=1) - ((y - centre[1]) ** 2).sum(axis=1)
            left = lean <= 0
            if not 0.25 <= left.mean() <= 0.75:
                left = lean <= np.median(lean)
            if left.all() or not left.any():
                break
            centre = np.stack([y[left].mean(axis=0), y[~left].mean(axis=0)])
        if left.all() or not left.any():  # all alike
            done.append(y.mean(axis=0))
        else:
            todo += [part[left], part[~left]]
    return np.stack(done)


def fit(sample: np.ndarray, rows: int, radius: float, k: int, target_recall: float, replica_ratio: float,
        seed: int = 7) -> Index:
    """Index from a bounded sample (rows x dimension) for a table of ``rows`` vectors."""
    rng = np.random.default_rng(seed)
    # as many lists as half the root of the rows: what a query reads grows with the root, not with the table
    lists = max(1, min(MAX_LISTS, rows // LIST_ROWS, int(rows ** 0.5 / 2) + 1))
    bare = Index(np.zeros((1, 1)), np.zeros((1, 1), np.int64), radius, 1.0, 1)
    lifted = bare.lift(sample)
    centroids = _halve(lifted, max(1, -(-len(sample) * 4 // (3 * lists))), rng)
    n = len(centroids)
    links = np.empty((n, min(LINKS, n)), np.int64)
    for lo in range(0, n, 512):
        gap = ((centroids[lo:lo + 512] ** 2).sum(axis=1)[:, None] + (centroids ** 2).sum(axis=1)
               - 2 * centroids[lo:lo + 512] @ centroids.T)
        links[lo:lo + 512] = np.argsort(gap, axis=1, kind="stable")[:, :links.shape[1]]
    # a few far links keep the graph in one piece
    links = np.concatenate([links, rng.integers(0, n, (n, 4))], axis=1)
    index = Index(centroids, links, radius, RATIOS[-1], n)
    asked = rng.choice(len(sample), min(200, len(sample)), replace=False)
    score = sample[asked] @ sample.T
    score[np.arange(len(asked)), asked] = -np.inf
    near = min(k, len(sample) - 1)
    if near <= 0:
        return index
    truth = np.argpartition(-score, near - 1, axis=1)[:, :near]
    wanted, place = np.unique(truth, return_inverse=True)
    place = place.reshape(truth.shape)
    homes = index.homes(lifted[wanted], replica_ratio)
    member = np.zeros((len(wanted), n), bool)
    for i, h in enumerate(homes):
        member[i, h] = True
    order, far = index.nearest(index.lift_queries(sample[asked]), n)
    for ratio in RATIOS:
        ok = far <= ratio * far[:, :1]
        hit = np.mean([member[place[i]][:, order[i][ok[i]]].any(axis=1).mean() for i in range(len(asked))])
        if hit >= target_recall:
            width = min(n, int(2 * ok.sum(axis=1).max()) + 16)
            return Index(centroids, links, radius, ratio, width)
    return index


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _routed(rows: DataFrame, index: Index, replica_ratio: float | None) -> DataFrame:
    """(list, id, v): one row per list; vectors go home, queries (no ratio) to what they probe."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch, index.centroids.shape[1] - 1)
            lists = index.probes(index.lift_queries(x)) if replica_ratio is None else index.homes(index.lift(x), replica_ratio)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(lists, pa.list_(pa.int32()))], ["vec_id", "lists"])

    return rows.mapInArrow(run, "vec_id long, lists array<int>")


def _search_block(k: int):
    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(vectors) or not len(queries):
            return empty
        vectors = vectors.sort_values("vec_id")
        v, q = np.stack(vectors["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        v_id, q_id = vectors["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        floor = queries["floor"].fillna(-np.inf).to_numpy()
        out = []
        for lo in range(0, len(q), 128):
            part, part_id = q[lo:lo + 128], q_id[lo:lo + 128]
            rough = part @ v.T
            rough[part_id[:, None] == v_id[None, :]] = -np.inf
            kth = np.partition(rough, -min(k, len(v)), axis=1)[:, -min(k, len(v))]
            room = 1e-9 * (1 + np.sqrt((part ** 2).sum(axis=1) * (v ** 2).sum(axis=1).max()))
            row, col = np.nonzero((rough >= (np.maximum(kth, floor[lo:lo + 128]) - room)[:, None]) & np.isfinite(rough))
            # the measure itself, always summed in the same order, so equal vectors tie exactly
            score = np.zeros(len(row))
            for j in range(v.shape[1]):
                score += part[row, j] * v[col, j]
            order = np.lexsort((v_id[col], -score, row))
            row, col, score = row[order], col[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = nth < k
            out.append(pd.DataFrame({"query_id": part_id[row[keep]], "vec_id": v_id[col[keep]], "score": score[keep]}))
        return pd.concat(out) if out else empty

    return run


def _blocks(vectors: DataFrame, queries: DataFrame, n_lists: int, k: int) -> DataFrame:
    """Best ``k`` of each query in each block, none below the query's ``floor``; both sides have list, vec_id, v."""
    v_count = {r["list"]: r["n"] for r in vectors.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per list
    q_count = {r["list"]: r["n"] for r in queries.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    splits = [(i, -(-v_count[i] // BLOCK_VECTORS), -(-q_count[i] // BLOCK_QUERIES)) for i in range(n_lists)
              if v_count.get(i) and q_count.get(i)]
    if not splits:
        splits = [(-1, 1, 1)]
    table = vectors.sparkSession.createDataFrame(splits, "s_list int, v_splits long, q_splits long")

    def side(rows: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        return (rows.join(F.broadcast(table), F.col("list") == F.col("s_list"))  # at most MAX_LISTS rows
                    .withColumn(mine, F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col(own)))
                    .withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
                    .select("list", "v_part", "q_part", *[c for c in rows.columns if c != "list"]))

    left = side(vectors, "v_splits", "q_splits", "v_part", "q_part").groupBy("list", "v_part", "q_part")
    right = side(queries, "q_splits", "v_splits", "q_part", "v_part").groupBy("list", "v_part", "q_part")
    return left.cogroup(right).applyInPandas(_search_block(k), "query_id long, vec_id long, score double")


def _merged(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (found.withColumn("twin", F.lag("vec_id").over(best) == F.col("vec_id"))
                 .where(~F.coalesce("twin", F.lit(False)))
                 .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))


def search(table: DataFrame, is_query, k: int = 20, target_recall: float = 0.96, replica_ratio: float = 1.02) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row of ``table`` (vec_id, embedding) where ``is_query``."""
    rows = cut(usable(table))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.max(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x))).alias("radius")).collect()[0]
    if not facts["n"]:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow().combine_chunks()
    sample = pa.concat_arrays(picked.column("v").chunks).flatten().to_numpy(zero_copy_only=False).reshape(picked.num_rows, -1)
    index = fit(sample, facts["n"], facts["radius"], k, target_recall, replica_ratio)
    n_lists = len(index.centroids)
    vectors = cut(_routed(rows, index, replica_ratio).select(F.col("vec_id").alias("h_id"), F.explode("lists").alias("list"))
                  .join(rows, F.col("h_id") == F.col("vec_id")).select("list", "vec_id", "v"))
    queries = rows.where(is_query)
    asked = cut(_routed(queries, index, None).select(F.col("vec_id").alias("h_id"), F.posexplode("lists").alias("nr", "list"))
                .join(queries, F.col("h_id") == F.col("vec_id")).select("list", "nr", "vec_id", "v"))
    last = asked.agg(F.max("nr")).collect()[0][0]
    found, lo, hi = None, 0, FIRST_LISTS
    while found is None or (last is not None and lo <= last):
        # nearest lists first; what they find is the floor for the farther ones
        now = asked.where((F.col("nr") >= lo) & (F.col("nr") < hi)).select("list", "vec_id", "v")
        if found is None:
            now = now.withColumn("floor", F.lit(None).cast("double"))
        else:
            floors = (found.where(F.col("rank") == k).select(F.col("query_id").alias("f_id"), F.col("score").alias("floor")))
            now = now.join(floors, F.col("vec_id") == F.col("f_id"), "left").drop("f_id")
        more = _blocks(vectors, now, n_lists, k)
        found = cut(_merged(more if found is None else found.select("query_id", "vec_id", "score").unionByName(more), k))
        lo, hi = hi, hi * WIDENING
    # queries whose lists held too few candidates: all lists, exactly
    full = min(k, facts["n"] - 1)
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= full)
    short = cut(queries.join(enough, F.col("vec_id") == F.col("query_id"), "left_anti"))
    if short.isEmpty():
        return found
    everywhere = (short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(n_lists - 1))))
                       .select("list", "vec_id", "v", F.lit(None).cast("double").alias("floor")))
    again = _merged(_blocks(vectors, everywhere, n_lists, k), k)
    return found.join(enough.select("query_id"), "query_id", "left_semi").unionByName(again)
