"""The rule ensemble: statistics and compiled rules against plain Python, held-out labels."""

import math
import random
import re
import zlib

import pytest
from tests_llm_shared import WORD, frame, sentence

from echotrace.llm import rule_ensemble as R
from echotrace.llm.common import docs_of, read_table

SF = "/root/testdata/sf0.01"


def plain_statistics(text):
    t = text or ""
    words, lines = WORD.findall(t), t.split("\n")
    n, ratio = len(words), lambda a, b: a / b if b else 0.0
    count = lambda pattern: len(re.findall(pattern, t))
    letters = sum(c.isalpha() for c in t)
    doubled, pieces = 0, re.split(r"([\x20\x09-\x0D])", t)
    i = 0
    while i + 2 < len(pieces):  # a word, one white space, the same word
        if pieces[i] and pieces[i] == pieces[i + 2]:
            doubled += 1
            i += 2
        i += 2
    return {
        "n_words": n, "n_lines": len(lines), "word_length": ratio(sum(map(len, words)), n), "line_words": ratio(n, len(lines)),
        "symbols": ratio(count(r"[#*$%&<>{}\[\]~^=+\\]"), len(t)), "exclaims": ratio(t.count("!"), n), "pipes": ratio(t.count("|"), n),
        "capitals": ratio(count("[A-Z\xC0-\xDE]"), letters), "digits": ratio(count("[0-9]"), len(t)), "letters": ratio(letters, len(t)),
        "sentence_ends": ratio(count("[.?]"), n), "commas": ratio(t.count(","), n), "distinct_words": ratio(len(set(words)), n) if n else 1.0,
        "distinct_lines": ratio(len(set(lines)), len(lines)), "doubled_words": ratio(doubled, n)}


def test_statistics_against_plain_python(spark, edge_rows):
    rows = edge_rows + [(50, "a a a b b\nb  b c c c c 12 | 3! Ä, {x}", "s"), (51, "\n\n", "s")]
    got = sorted(((r["doc_id"], [r[f"stat_{k}"] for k in R.STATISTICS]) for r in R.statistics(frame(spark, rows).select("doc_id", "text")).collect()), key=repr)
    expected = sorted(((i, [float(plain_statistics(t)[k]) for k in R.STATISTICS]) for i, t, _ in rows), key=repr)
    assert [i for i, _ in got] == [i for i, _ in expected]
    for (i, a), (_, b) in zip(got, expected):
        assert a == pytest.approx(b, abs=1e-12), i


@pytest.fixture(scope="module")
def model(spark):
    docs, labels = docs_of(spark, SF), read_table(spark, SF, "labels")
    return R.train(docs, labels.where(~R.held_out(R.F.col("doc_id"))))


def test_compiled_rules_are_the_rules(spark, model, edge_rows):
    assert 3 <= len(model.rules) <= 150
    assert all(1 <= len(rule.bounds) <= 3 for rule, _ in model.rules)
    got = R.classify(frame(spark, edge_rows), model, threshold=0.3).select("doc_id", "score", "predicted").collect()
    expected = []
    for doc_id, text, _ in edge_rows:
        values = plain_statistics(text)
        score = 1 / (1 + math.exp(-(model.intercept + sum(w for rule, w in model.rules if rule.holds(values)))))
        expected.append((doc_id, score, int(score >= 0.3)))
    for a, b in zip(sorted((tuple(r) for r in got), key=repr), sorted(expected, key=repr)):
        assert a[0] == b[0] and a[1] == pytest.approx(b[1], abs=1e-9) and a[2] == b[2]


def test_held_out_documents(spark):
    from echotrace.llm import queries

    got = queries.op11_quality_classifier(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = got.collect()
    assert len(rows) == docs_of(spark, SF).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    truth = {r["doc_id"]: r["quality"] for r in read_table(spark, SF, "labels").collect()}
    pairs = [(r["score"], truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, poor = [s for s, q, _ in pairs if q], [s for s, q, _ in pairs if not q]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in poor) / (len(good) * len(poor)) >= 0.97
    assert sum(q == p for _, q, p in pairs) / len(pairs) >= 0.95


def test_only_the_text_counts(spark, model):
    rng = random.Random(2)
    text = sentence(rng, 80)
    rows = [(i, text, s) for i, s in ((1, "a"), (2, None), (None, "b"))]
    scores = {r["score"] for r in R.classify(frame(spark, rows).withColumnRenamed("target", "score"), model).collect()}
    assert len(scores) == 1


def test_labels_of_one_class_none_or_several(spark):
    rng = random.Random(6)
    docs = frame(spark, [(i, sentence(rng, 30), "s") for i in range(30)])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, score in (([], 0.5), ([(1, 1), (2, 1), (None, 0), (3, None), (4, 7)], 1.0), ([(1, 0), (1, 1)], 0.0), ([(99, 1)], 0.5)):
        model = R.train(docs, labels(rows))
        assert model.rules == () and {r["score"] for r in R.classify(docs, model).collect()} == {score}
    assert R.classify(docs.limit(0), model).collect() == []
    twice = docs.unionByName(docs)
    assert R.training_rows(twice, labels([(i, i % 2) for i in range(30)])).count() == 30
    assert R.training_rows(twice, labels([(i, i % 2) for i in range(30)]), sample_docs=11).count() == 11
