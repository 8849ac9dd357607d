"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests_llm_shared import WORD, frame, sentence

from echotrace.llm import periodic_runs
from echotrace.llm.periodic_runs import SquareCatchers, runs_of_slice


def plain_runs(words, min_exponent, min_length):
    """All (start, length, period) by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            a = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - a >= max(min_length, min_exponent * q):
                found.setdefault((a, i - a), q)
    return sorted((a, length, q) for (a, length), q in found.items())


def caught(texts, min_exponent, min_length):
    sizes = np.array([len(t) for t in texts], np.int64)
    word = np.array([w for t in texts for w in t], np.int64)
    start, end, period = runs_of_slice(word, sizes, min_exponent, min_length)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = [[] for _ in texts]
    for a, b, q in zip(start.tolist(), end.tolist(), period.tolist()):
        t = int(np.searchsorted(bounds, a, side="right")) - 1
        out[t].append((a - int(bounds[t]), b - a, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=4), st.sampled_from([(2, 2), (3, 5), (4, 6)]))
def test_random_words_against_every_period(texts, least):
    assert caught(texts, *least) == [plain_runs(t, *least) for t in texts]


@pytest.mark.parametrize("least", [(2, 2), (4, 6)])
def test_nested_and_long_periods(least):
    rng = random.Random(3)
    texts = []
    for p in (1, 2, 3, 5, 8, 13, 31, 32, 33, 100):
        block = [rng.randrange(40) for _ in range(p)]
        texts.append([50 + rng.randrange(5) for _ in range(rng.randrange(9))] + (block * 9)[:8 * p + rng.randrange(p)] + [7, 7, 7, 7, 7, 7, 7] + block * 4)
    inner = [1, 1, 1, 1, 1, 1, 2]
    texts += [inner * 6, (inner * 5 + [3]) * 5, [1] * 3000, [1, 2] * 700 + [1], []]
    assert caught(texts, *least) == [plain_runs(t, *least) for t in texts]


def test_words_appended_one_at_a_time_or_in_parts():
    rng = random.Random(8)
    words = [rng.randrange(3) for _ in range(50)] + [4, 5, 6] * 9 + [1] * 12 + list(range(30)) * 5
    expected = plain_runs(words, 2, 2)
    for step in (1, 7, len(words)):
        online = SquareCatchers(2, 2)
        for i in range(0, len(words), step):
            online.append(np.array(words[i:i + step]))
            if i % 35 == 0:  # what is known so far
                start, end, period = online.runs()
                assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == plain_runs(words[:i + step], 2, 2)
        start, end, period = online.runs()
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == expected
        assert online.proven(start, end, period)


def test_a_false_run_is_not_proven():
    online = SquareCatchers(2, 2)
    online.append(np.array([1, 2, 1, 3]))
    assert not online.proven(np.array([0]), np.array([4]), np.array([2]))  # a wrong word
    online.append(np.array([3, 3]))
    assert not online.proven(np.array([3]), np.array([5]), np.array([1]))  # one more word belongs to it


def contract(rows):
    """Expected rows of the query by plain Python."""
    out = []
    for doc_id, text, _ in rows:
        w = WORD.findall(text or "")
        n, h = len(w), None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if n and h is not None and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(w, 4, 6)
        dropped = {i for a, length, q in runs for i in range(a + q, a + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                    digest("".join(f"{a},{length},{q}\n" for a, length, q in runs)),
                    digest(" ".join(x for i, x in enumerate(w) if i not in dropped))))
    return sorted(out, key=repr)


def test_query_on_edge_rows(spark, edge_rows, tmp_path):
    from echotrace.llm import queries

    rng = random.Random(11)
    rows = [(i, "x\x0cy " * 30 if t and len(t) > 20_000 else t, s) for i, t, s in edge_rows]
    rows += [(100 + i, sentence(rng, 40 + i), "s") for i in range(120)] + [(300, "a  b\t" * 7, "s"), (301, "z " * 6, "s"), (302, "z " * 5, "s")]
    rows += [(None, "q r " * 9, "s")] * 2
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == contract(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = frame(spark, [(1, "b a a a", "s")]).withColumnRenamed("found", "runs").withColumnRenamed("target", "collapsed")
    got = periodic_runs.find_runs(docs, min_exponent=3).collect()[0]
    assert got["collapsed"] == "b a" and [tuple(r) for r in got["runs"]] == [(1, 3, 1)] and got["source"] == "s"
    assert periodic_runs.digests(periodic_runs.find_runs(docs.limit(0))).collect() == []


def test_long_text_of_one_word(spark):
    docs = spark.createDataFrame([(1, "ha " * 300_000)], "doc_id long, text string")
    got = periodic_runs.find_runs(docs, min_exponent=4, min_length=6).collect()[0]
    assert [tuple(r) for r in got["runs"]] == [(0, 300_000, 1)] and got["collapsed"] == "ha"
