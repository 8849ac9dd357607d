"""Each stage of the pipeline against brute force on its own input."""
import corpus_pipeline as P
from tests_llm_shared import WORD, frame

import __spark_entry__ as entry
from echotrace.llm import quality_crf
import test_minmax_dedup
from test_mix_sources import targets
from test_secret_ledger import base_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, seen = docs, {}
    for name, stage in P.STAGES:
        stage(spark, out, SF).write.parquet(str(tmp_path / name))
        before, out = out, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before.collect(), out.collect())
        if name != "best_fit_packing":
            assert out.columns == docs.columns
    before, after = seen["quality_rules"]
    model = quality_crf.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality_crf.verdicts(docs, model).collect() if r.kept}
    assert {r.doc_id for r in after} == kept and set(after) <= set(before)
    before, after = seen["near_duplicates"]
    _, root = test_minmax_dedup.brute([(r.doc_id, r.text) for r in before], 5)
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for i, r in enumerate(before) if root[i] == r.doc_id)
    before, after = seen["secret_scan"]
    old = {r.doc_id: r for r in before}
    assert len(after) == len(before)
    for r in after:
        assert base_spans(r.text) == "" and (r.text == old[r.doc_id].text) == (base_spans(old[r.doc_id].text) == "")
    before, after = seen["source_mix"]
    size = {r.doc_id: len(WORD.findall(r.text)) for r in before}
    sizes, longest, taken, copies = {}, {}, {}, {}
    for r in before:
        sizes[r.source] = sizes.get(r.source, 0) + size[r.doc_id]
        longest[r.source] = max(longest.get(r.source, 0), size[r.doc_id])
    for r in after:
        taken[r.source] = taken.get(r.source, 0) + size[r.doc_id]
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    for s, t in targets(sizes).items():
        assert abs(taken.get(s, 0) - t) <= longest[s] / 2 + 1
    before, after = seen["best_fit_packing"]
    fill = {}
    for r in after:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len([r for r in after if r.piece == 0]) == len(before)
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_run_and_registry(spark):
    names = entry.queries()
    assert names["pipeline"] is P.run and len([n for n in names if n.startswith("op")]) == 13
    assert set(P.run(spark, SF).columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "crossovers", "migrants"}


def test_stages_on_edges(spark, edge_rows):
    docs = frame(spark, edge_rows)
    for name, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        stage(spark, docs, SF).count()
