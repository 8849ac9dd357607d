import random

import numpy as np
import pyarrow as pa
from tests_llm_shared import WORD, frame, sentence

from echotrace.llm import minmax_dedup as M


def shingles(text, n=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, n=4):
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(ids) if ids and sets[i] else rows[i][0]
    return sets, out


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = sentence(rng, 1) + "x"
    return " ".join(w)


def make(rng):
    rows = [(i, sentence(rng, rng.randint(1, 60))) for i in range(60)]
    for base in range(4):
        text = sentence(rng, 120)
        rows += [(1000 * (base + 1) + i, edited(rng, text, rng.randint(0, 6))) for i in range(25)]
    chain = sentence(rng, 150).split()
    for i in range(20):  # neighbours are linked, the ends are not
        chain[6 * i:6 * i + 3] = ["q%dx" % i] * 3
        rows.append((9000 + i, " ".join(chain)))
    rng.shuffle(rows)
    return rows


def check(spark, rows):
    sets, want = brute(rows)
    got = M.near_duplicates(frame(spark, [(i, t, "s") for i, t in rows])).collect()
    assert len(got) == len(rows)
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in got)
    assert have == sorted((i is None, i or 0, len(s), want[k] or 0, want[k] == i) for k, ((i, _), s) in enumerate(zip(rows, sets)))
    return got


def test_against_brute_force(spark, monkeypatch):
    rows = make(random.Random(8))
    check(spark, rows)
    monkeypatch.setattr(M, "BLOCK", 3)  # buckets finished in many blocks
    monkeypatch.setattr(M, "BROADCAST_IDS", 0)
    check(spark, rows)


def test_edges(spark, edge_rows):
    rows = [(i, t) for i, t, _ in edge_rows]
    got = check(spark, rows)
    docs = frame(spark, edge_rows)
    kept = M.one_of_each_group(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and ids.count(3) <= 1 and {4, 5, 6, -3} <= set(ids)
    assert sum(r.first_row for r in got) == len(ids)
    assert M.near_duplicates(docs.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = random.Random(3)
    a = sentence(rng, 400)
    values, size = M.shingle_sets(pa.array([a, edited(rng, a, 15)]))
    x, y = set(values[:size[0]].tolist()), set(values[size[0]:].tolist())
    assert [len(x), len(y)] == [len(shingles(a)), size[1]]
    prints, keys, _ = M.signatures(values, size)
    assert (prints[0] != prints[1]).any() and keys.shape == (2, M.BANDS)
    shared = np.mean(keys[0] == keys[1])
    similarity = len(x & y) / len(x | y)
    assert abs(shared - similarity ** M.ROWS) < 0.35
