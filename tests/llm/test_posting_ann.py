import numpy as np
import pytest
from pyspark.sql import functions as F

from echotrace.llm import posting_ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, v string, list int"


def table(spark, rows):
    return spark.createDataFrame([(i, x, 1, "clash", 2) for i, x in rows], SCHEMA)


def brute(rows, k=20):
    good = [(i, np.array(x, np.float32).astype(float)) for i, x in rows
            if i is not None and x and all(y is not None and np.isfinite(y) for y in x) and any(x)]
    dim = max({len(x) for _, x in good}, key=lambda d: (sum(len(x) == d for _, x in good), d), default=0)
    good = [(i, x) for i, x in {(i, tuple(x)): x for i, x in good if len(x) == dim}.items()]
    out = {}
    for (q, _), x in good:
        if q % 20 == 0:
            found = sorted(((-float(sum(a * b for a, b in zip(x, y))), i) for (i, _), y in good if i != q))[:k]
            out[q] = [(i, -s) for s, i in found]
    return out


def run(spark, rows, **kw):
    got = {}
    for r in A.search(table(spark, rows), F.col("vec_id") % 20 == 0, **kw).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


def test_edges_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(200, None), (220, []), (240, [0.0] * 8), (260, [None] + [1.0] * 7), (280, [float("nan")] * 8), (300, [float("inf")] * 8),
             (320, [1.0, 2.0]), (None, [1.0] * 8), (5, rows[5][1]), (5, rows[5][1])]
    want = brute(rows)
    got = run(spark, rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)
    assert run(spark, rows[:5]) .keys() == {0} and len(run(spark, rows[:5])[0]) == 4
    assert run(spark, rows[:1]) == {} and run(spark, []) == {}


def test_recall_with_many_lists_and_a_common_vector(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_ROWS", 30)
    monkeypatch.setattr(A, "BLOCK_VECTORS", 200)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + 0.4 * rng.normal(size=16)).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(700)]
    want, got = brute(rows), run(spark, rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)


def test_short_queries_are_searched_everywhere(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_ROWS", 2)
    monkeypatch.setattr(A, "RATIOS", (1.0,))
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(45)]
    got, want = run(spark, rows, target_recall=0.0), brute(rows)
    assert {q: len(v) for q, v in got.items()} == {q: 20 for q in want}


def test_different_vectors_of_one_id(spark):
    """The least vector of an id counts, as a candidate and as a query."""
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(50)]
    again = [(i, rng.normal(size=6).round(3).tolist()) for i in (0, 3, 20, 20)]
    least = {}
    for i, x in rows + again:
        key = tuple(np.array(x, np.float32).astype(float).tolist())
        least[i] = min(least.get(i, key), key)
    got, want = run(spark, rows + again), brute([(i, list(x)) for i, x in least.items()])
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
