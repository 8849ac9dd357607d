import itertools
from collections import Counter

import numpy as np
from tests_llm_shared import WORD, frame

from echotrace.llm import quality_crf as Q


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = list(zip(w, w[1:], w[2:]))
    n = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(marked)


def test_base_counts_and_edges(spark, edge_rows):
    docs = frame(spark, edge_rows)
    got = Q.verdicts(docs.select("doc_id", "text", "kept"), Q.CrfModel.neutral()).collect()
    assert len(got) == len(edge_rows)
    for r in got:
        want = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)  # the neutral model calls every line content
    assert Q.verdicts(docs.limit(0), Q.CrfModel.neutral()).count() == 0
    kept = Q.kept_documents(docs, Q.CrfModel.neutral())
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        scores, trans = rng.normal(size=(n, 2)), rng.normal(size=(2, 2))
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) + sum(trans[x, y] for x, y in zip(p, p[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert tuple(Q.viterbi(scores, trans)) == best


def test_forward_backward_gradient_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = Q.train(docs, labels.where("doc_id % 2 = 0"))
    held = Q.verdicts(docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("doc_id", "text", "quality"), model).collect()
    good = [r.kept for r in held if r.quality == 1 and not r.base_failed]
    poor = [r.kept for r in held if r.quality == 0]
    assert np.mean(good) >= 0.98 and np.mean(poor) <= 0.05


def test_without_both_classes_all_lines_are_content(spark):
    docs = frame(spark, [(1, "word " * 60, "s")])
    none = spark.createDataFrame([(1, None), (None, 1), (1, 3)], "doc_id long, quality int")
    model = Q.train(docs, none)
    assert (model.state == Q.CrfModel.neutral().state).all()
