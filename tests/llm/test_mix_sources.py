import pytest
from tests_llm_shared import WORD, frame

from echotrace.llm import mix_sources as M


def targets(sizes, weights=(5, 2, 1)):
    """The contract's loop: share by weight, cap at three times, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= set(over)


@pytest.mark.parametrize("broadcast", [50_000, 0])
def test_targets_and_taken(spark, edge_rows, monkeypatch, broadcast):
    monkeypatch.setattr(M, "BROADCAST_SOURCES", broadcast)
    rows = edge_rows + [(100 + i, "w " * (i % 7 + 1), f"s{i % 5}") for i in range(300)]
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes, longest = {}, {}
    for i, t, s in rows:
        n = len(WORD.findall(t or ""))
        sizes[s] = sizes.get(s, 0) + n
        longest[s] = max(longest.get(s, 0), n)
    want = targets(sizes)
    for s in sizes:
        part = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(want[s]) for r in part)
        assert abs(sum(r.taken for r in part) - want[s]) <= longest[s] / 2 + 1
        assert all(r.taken <= 3 * r.size for r in part)
    again = M.mix(frame(spark, rows[::-1])).collect()
    key = lambda r: (r.doc_id or 0, r.source or "", r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_null_ids_and_exact_repeats_meet_the_target(spark, tmp_path):
    import duckdb

    from echotrace.llm import queries

    rows = [(None, "w " * (i % 7 + 1), "a") for i in range(400)] + [(5, "same words here", "b")] * 300 + [(None, None, "b")] * 9
    rows += [(i, "x " * (i % 5 + 1), "c") for i in range(900)]
    frame(spark, rows).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = M.mix(docs).collect()
    sizes = {s: sum(len(WORD.findall(t or "")) for _, t, x in rows if x == s) for s in "abc"}
    for s, t in targets(sizes).items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 7 / 2 + 1, s
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(queries.SQL["op3_mix_sources"]).fetchall(), key=repr)
    assert sorted((tuple(r) for r in queries.op3_mix_sources(spark, str(tmp_path)).collect()), key=repr) == want
    mixed = M.mixed_documents(docs)
    assert mixed.count() == sum(r.copies for r in got)
    assert mixed.where("source = 'b' and text is not null").count() == sum(r.copies for r in got if r.source == "b" and r.size)


def test_mixed_documents_and_empty(spark, edge_rows):
    docs = frame(spark, edge_rows)
    mixed = M.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = {}
    for r in M.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.copies
    have = {}
    for r in mixed.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + 1
    assert have == {k: v for k, v in taken.items() if v}
    assert M.mix(docs.limit(0)).count() == 0
    nothing = M.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert all(r.target == 0 and r.taken == 0 for r in nothing)
