"""Sentences, words, lines and concordance."""

import pytest
from pyspark.sql import functions as F

from echotrace.functions import segment as seg
from tests.conftest import one

FIRST_CASES = [
    ("One. Two! Three?", ("One.", "", "Three?")),
    ("A b. C d.\n\nE f. G h.\n\nI j. K l.", ("A b.", "E f.", "K l.")),
    ("가다. 나다!", ("가다.", "", "나다!")),
    ("다다.라라. ab.cd", ("다다.", "", "ab.cd")),
    ("no terminator", ("no terminator", "", "no terminator")),
    ("", ("", "", "")),
    ("  lead. trail  ", ("lead.", "", "trail")),
]


@pytest.mark.parametrize("text,expected", FIRST_CASES)
def test_first_sentences(spark, text, expected):
    r = one(spark, seg.first_sentences(F.col("x")), text)
    assert (r["first"], r["second"], r["last"]) == expected


def test_sentences(spark):
    assert one(spark, seg.sentences(F.col("x")), "One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, seg.sentences(F.col("x")), "") == []


def test_words_and_lines(spark):
    assert one(spark, seg.words(F.col("x")), "  a\tb　c  ") == ["a", "b", "c"]
    assert one(spark, seg.words(F.col("x")), "   ") == []
    assert one(spark, seg.lines(F.col("x")), "a\n\nb\n") == ["a", "b"]


def test_concordance(spark):
    df = spark.createDataFrame([(1, "a the b athens c d the e f")], "id int, text string")
    got = [(r["pos"], r["context"]) for r in seg.concordance(df, "text", "the").orderBy("pos").collect()]
    assert got == [(1, "a the b athens"), (3, "a the b athens c d"), (6, "athens c d the e f")]
    assert one(spark, seg.concordance_positions(F.col("x"), "zzz"), "a b") == []
