"""Best-fit packing by a grouping genetic algorithm on islands.

Only (piece, length) rows are packed; texts and ids never move.  Pieces are
dealt at random into shards of about ``SHARD_PIECES``, or of more where these do
not fill ``SHARD_SEQUENCES`` sequences (so every round settles some bins).  Each shard is evolved by
several islands, every one a task of its own:

* first solutions: best fit over pieces shuffled as a whole or inside bands of lengths;
* crossover: the well-filled bins of one parent are injected whole into the
  other, its bins that hold an injected piece are dissolved, and the displaced
  pieces go best-fit, longest first, into the gaps or new bins;
* fitness: few bins first, then the mean squared fill;
* after an epoch the elite of each island migrates to the next island, where its
  first crossover is with that island's own elite.

The best island of a shard gives its bins.  The worst-filled few of them are
dissolved, and their pieces are dealt into new shards together with those of all
other shards, until one shard is left: what a shard cannot fill meets the rest.
An epoch ends at the lower bound ``ceil(sum of lengths / capacity)``, after its first
crossovers at the earliest, so every settled bin comes out of crossover and
migration; ``crossovers`` and ``migrants`` say how many its shard has seen.

Defined results: a null or empty text has the end id alone; only longer documents
are cut; rows with equal ids stay separate, and pieces of equal length (ties) are
told apart by their row number; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import math
import random
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echotrace.llm.arrow_text import plain_strings, slices
from echotrace.llm.common import cut
from echotrace.llm.token_ids import WordEncoder

#: Text bytes encoded at once inside a task: an encoder's arrays take some forty times as many.
ENCODED_BYTES = 1 << 20
SHARD_PIECES = 4000
#: Sequences that a shard's tokens fill on average, at least: one that fills a single bin may release all it has.
SHARD_SEQUENCES = 4
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 20
POPULATION = 3
#: Bands of lengths, in parts of the capacity, of every other first solution.
BANDS = 8
#: Share of a shard's bins (and the fill they must miss) that meets other shards' again.
RELEASED, WELL_FILLED = 0.02, 0.995

Solution = list[list[int]]


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): documents as ids, cut only beyond ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = WordEncoder.at(tokenizer), TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", ENCODED_BYTES):
                ids, per_doc = encoder.encode(plain_strings(part.column("text")), end_id)
                raw = memoryview(ids.astype("<u4").tobytes())
                end = np.cumsum(per_doc)
                out: list[tuple] = []
                for doc_id, lo, hi in zip(part.column("doc_id").to_pylist(), (end - per_doc).tolist(), end.tolist()):
                    for nr, at in enumerate(range(lo, hi, capacity)):
                        stop = min(hi, at + capacity)
                        out.append((row, doc_id, nr, at - lo, stop - at, zlib.crc32(raw[4 * at:4 * stop])))
                        row += 1
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of pieces with their fill."""

    def __init__(self, bins: Solution | None = None, fill: list[int] | None = None):
        self.bins, self.fill = bins or [], fill or []

    def rank(self) -> tuple[int, float]:
        """Few bins first, then full ones (mean squared fill)."""
        return len(self.fill), -sum(f * f for f in self.fill) / max(1, len(self.fill))


def filled(bins: Solution, length: list[int]) -> Packing:
    return Packing(bins, [sum([length[p] for p in b]) for b in bins])


def best_fit(packing: Packing, pieces: list[int], length: list[int], capacity: int) -> None:
    """Put each piece into the bin with the least room that holds it, else into a new one."""
    bins, fill = packing.bins, packing.fill
    room = sorted((capacity - f, b) for b, f in enumerate(fill) if f < capacity)
    find, put = bisect.bisect_left, bisect.insort
    for p in pieces:
        n = length[p]
        i = find(room, (n, -1))
        if i < len(room):
            left, b = room.pop(i)
            bins[b].append(p)
            fill[b] += n
        else:
            b, left = len(bins), capacity
            bins.append([p])
            fill.append(n)
        if left > n:
            put(room, (left - n, b))


def crossover(one: Packing, other: Packing, length: list[int], capacity: int, rng: random.Random) -> Packing:
    """``other`` with some of the best-filled bins of ``one`` injected whole."""
    ranked = sorted(range(len(one.bins)), key=lambda b: -one.fill[b])
    injected = [b for b in ranked[:max(1, len(ranked) // 2)] if rng.random() < 0.5] or ranked[:1]
    taken = {p for b in injected for p in one.bins[b]}
    kept = [(one.fill[b], one.bins[b]) for b in injected]
    displaced: list[int] = []
    for f, b in zip(other.fill, other.bins):
        if taken.isdisjoint(b):
            kept.append((f, b))
        else:
            displaced += [p for p in b if p not in taken]
    # the emptiest of the child are dissolved too, so that gaps are dealt anew
    kept.sort(key=lambda x: -x[0])
    for _ in range(min(max(2, len(kept) // 10), len(kept) - 1)):
        displaced += kept.pop()[1]
    displaced.sort(key=lambda p: (-length[p], p))
    child = Packing([list(b) for _, b in kept], [f for f, _ in kept])
    best_fit(child, displaced, length, capacity)
    return child


@dataclass
class Evolution:
    """What an epoch on an island came to."""

    best: Packing
    crossovers: int
    migrants: int


def evolve(length: list[int], capacity: int, elites: list[Packing], rng: random.Random, generations: int = GENERATIONS) -> Evolution:
    """One epoch of an island; ``elites``: its own of the epoch before, then those that came from other islands."""
    bound = -(-sum(length) // capacity)
    people = list(elites)
    while len(people) < (2 if elites else POPULATION):
        order = list(range(len(length)))
        rng.shuffle(order)
        if len(people) % 2:  # shuffled inside bands of lengths, long ones first
            order.sort(key=lambda p: -(length[p] * BANDS // capacity))
        fresh = Packing()
        best_fit(fresh, order, length, capacity)
        people.append(fresh)
    couples = [(elites[0], guest) for guest in elites[1:]]  # migrants meet the elite of the island first
    ranked = sorted(((s.rank(), i, s) for i, s in enumerate(people)))
    crossovers = 0
    for _ in range(generations):
        one, other = couples.pop() if couples else rng.sample([s for _, _, s in ranked], 2)
        for a, b in ((one, other), (other, one)):
            child = crossover(a, b, length, capacity, rng)
            crossovers += 1
            ranked.append((child.rank(), len(people) + crossovers, child))
            if len(child.fill) <= bound and not couples:
                break
        ranked = sorted(ranked)[:POPULATION]
        if ranked[0][0][0] <= bound and not couples:
            break
    return Evolution(ranked[0][2], crossovers, len(elites[1:]))


SOLVED = "shard long, island int, uid long, length long, bin int, crossovers long, migrants long"


def _island(capacity: int, round_nr: int, epoch: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        items = rows[["uid", "length"]].drop_duplicates("uid").sort_values("uid")
        uid, length = items["uid"].tolist(), items["length"].tolist()
        index = {u: i for i, u in enumerate(uid)}
        elites: list[Packing] = []
        crossovers = migrants = 0
        if epoch:
            crossovers, migrants = int(rows["crossovers"].max()), int(rows["migrants"].max())
            for _, solution in rows.sort_values("uid").groupby("origin", sort=True):
                bins: dict[int, list[int]] = {}
                for u, b in zip(solution["uid"].tolist(), solution["bin"].tolist()):
                    bins.setdefault(b, []).append(index[u])
                elites.append(filled([bins[b] for b in sorted(bins)], length))
        found = evolve(length, capacity, elites, random.Random(f"{round_nr}:{epoch}:{shard}:{island}"))
        flat = [(uid[p], length[p], b) for b, members in enumerate(found.best.bins) for p in members]
        out = pd.DataFrame(flat, columns=["uid", "length", "bin"])
        out["shard"], out["island"] = shard, island
        out["crossovers"], out["migrants"] = crossovers + found.crossovers, migrants + found.migrants
        return out[["shard", "island", "uid", "length", "bin", "crossovers", "migrants"]]

    return run


def _settle(capacity: int, round_nr: int, release: bool):
    """Best island of a shard: places of its pieces, and which bins are dissolved again."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])

        def rank(solution: pd.DataFrame) -> tuple:
            fill = solution.groupby("bin")["length"].sum().to_numpy() / capacity
            return len(fill), -float((fill ** 2).mean())

        best = min((s for _, s in rows.groupby("island", sort=True)), key=rank).sort_values(["bin", "uid"])
        fill = best.groupby("bin")["length"].sum()
        loose = fill[fill < WELL_FILLED * capacity].sort_values(kind="stable")
        loose = set(loose.index[:max(1, math.ceil(RELEASED * len(fill)))]) if release else set()
        return pd.DataFrame({
            "uid": best["uid"], "length": best["length"],
            "sequence_id": (round_nr << 56) + (shard << 16) + best["bin"].astype("int64"),
            "offset": best.groupby("bin")["length"].cumsum() - best["length"],
            "settled": ~best["bin"].isin(loose), "crossovers": best["crossovers"], "migrants": best["migrants"]})

    return run


def pack(pieces: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(uid, length) -> (uid, sequence_id, offset, crossovers, migrants); no length may exceed ``capacity``."""
    todo, done, round_nr = pieces.select("uid", "length"), None, 0
    while True:
        n, tokens = todo.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).collect()[0]
        shards = max(1, min(-(-n // shard_pieces), -(-tokens // (SHARD_SEQUENCES * capacity))))
        dealt = todo.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(round_nr)), F.lit(shards)))
        dealt = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
        solved = dealt.groupBy("shard", "island").applyInPandas(
            _island(capacity, round_nr, 0), SOLVED)
        for epoch in range(1, epochs):
            # the elite of an island is a seed there and on the next island
            own = solved.withColumn("origin", F.lit(0))
            guest = solved.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands))).withColumn("origin", F.lit(1))
            solved = own.unionByName(guest).groupBy("shard", "island").applyInPandas(
                _island(capacity, round_nr, epoch), SOLVED)
        placed = cut(solved.groupBy("shard").applyInPandas(
            _settle(capacity, round_nr, shards > 1),
            "uid long, length long, sequence_id long, offset long, settled boolean, crossovers long, migrants long"))
        now = placed.where("settled").select("uid", "sequence_id", "offset", "crossovers", "migrants")
        done = now if done is None else done.unionByName(now)
        if shards == 1:
            return done
        todo, round_nr = placed.where("not settled").select("uid", "length"), round_nr + 1


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, crossovers, migrants."""
    pieces = cut(token_pieces(docs, tokenizer, end_id, capacity))
    places = pack(pieces, capacity).withColumnRenamed("uid", "p_uid")
    return (pieces.join(places, F.col("uid") == F.col("p_uid"))
                  .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "crossovers", "migrants"))
