"""Importance resampling against plain Python and its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tests_llm_shared import frame, sentence

from echotrace.llm import importance_resampling as ir

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, max_words):
    w = WORDS.findall((text or "").translate(UPPER))
    return w, [" ".join(w[i:i + n]) for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, max_words=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text, _ in rows for f in features(text, max_words)[1])
    t = Counter(bucket(f) for text in target for f in features(text, max_words)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for doc_id, text, _ in rows:
        words, found = features(text, max_words)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): i for i, r in enumerate(able[:percent * len(able) // 100], 1)}
    return sorted(((*r[:4], ranks.get(id(r))) for r in out), key=repr)


@pytest.fixture
def rows(edge_rows):
    rng = random.Random(4)
    more = [(100 + i, sentence(rng, rng.randrange(5, 60)) + rng.choice([".", "!", " THE End", "\x00x", "ß-É_é"]), "s") for i in range(150)]
    long_words = [(900, "w" * 40 + " " + "w" * 41 + " " + "é" * 300 + " " + "é" * 300, "s"), (901, " ".join(["w" * 31, "w" * 32, "w" * 33] * 9), "s")]
    return edge_rows + more + long_words


TARGET = ["ka lo mi ter", None, "", "THE end. " * 5, "or das pe ru"]


@pytest.mark.parametrize("max_words", [1, 3])
def test_against_plain_python(spark, rows, max_words):
    docs, target = frame(spark, rows), spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = ir.resample(docs, target, max_words=max_words, seed=2024, percent=30, buckets=500)
    got = got.select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, TARGET, max_words, 500, 30)


def test_query_and_sql(spark, rows, tmp_path):
    from echotrace.llm import queries

    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = queries.op12_importance_resampling(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    got = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got == plain(rows, TARGET)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(con.sql(queries.SQL["op12_importance_resampling"]).fetchall(), key=repr) == got


def test_hash_is_xxhash64():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(0, 70), 200, 1000]]
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8).copy()
    length = np.array([len(t) for t in texts])
    got = ir.ByteRanges(data).xxhash64(np.cumsum(length) - length, length)
    assert got.tolist() == [xxhash.xxh64_intdigest(t) for t in texts]


def test_table_grows_and_tells_equal_hashes_apart():
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(3000)] + ["x" * 100, "x" * 99 + "y"] * 2
    data = np.frombuffer("".join(words).encode() + bytes(8), np.uint8).copy()
    length = np.array([len(w) for w in words])
    start = np.cumsum(length) - length
    for hashes in (None, np.zeros(len(words), np.uint64), np.arange(len(words), dtype=np.uint64) * 0 + np.uint64(7)):
        ranges = ir.ByteRanges(data)
        some = slice(None) if hashes is None else slice(-300, None)  # one hash for all: the bytes decide
        table = ir.InternTable(ranges, start[some], length[some], 2, None if hashes is None else hashes[some])
        groups = {}
        for w, s in zip(words[some], table.slot.tolist()):
            groups.setdefault(s, set()).add(w)
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(words[some]))
        assert table.counts()[table.slot].tolist() == [words[some].count(w) for w in words[some]]
        assert table.buckets(97)[table.slot].tolist() == [zlib.crc32(w.encode()) % 97 for w in words[some]]


def test_small_chunks_move_slots(monkeypatch):
    monkeypatch.setattr(ir, "PROBE", 8)
    texts = pa.array([sentence(random.Random(i), 50) for i in range(10)])
    ranges, start, length, _, _ = ir.ngrams(texts, 2)
    table = ir.InternTable(ranges, start, length, 16)
    seen = {}
    for a, n, s in zip(start.tolist(), length.tolist(), table.slot.tolist()):
        assert seen.setdefault(s, bytes(ranges.view[a:a + n])) == bytes(ranges.view[a:a + n])
    assert len(seen) == len(set(seen.values()))


def test_empty_tables_ties_and_order_of_partitions(spark):
    empty = frame(spark, [])
    assert ir.resample(empty, empty).collect() == []
    rows = [(i % 40, "w " * (20 + i % 3), "s") for i in range(400)]
    docs = frame(spark, rows).repartition(13)
    got = ir.resample(docs, empty, percent=100, seed=2024, keep=("source",)).select("rank", "score", "doc_id", "n_features", "source").collect()
    got.sort(key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(1, 401)) and {r["source"] for r in got} == {"s"}
    assert [tuple(r)[1:4] for r in got] == sorted((tuple(r)[1:4] for r in got), key=lambda r: (-r[0], r[1], r[2]))
