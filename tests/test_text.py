"""Golden tests for Column text functions."""

import pytest
from pyspark.sql import functions as F

from echotrace.functions import text as tx
from tests.conftest import one

CLEAN_CASES = [
    (None, ""), ("nan", ""), (" NaN ", ""), ("ㅋㅋㅋ", ""),
    ("at 10:30 now", "at now"), ("speed 1.25x ok", "speed ok"), ("출처: a\nb", "b"),
    ("p / 12.5 q", "p q"), ("wow!! yes", "wow yes"), ("a&nbsp;b", "ab"), ("it&#39;s", "its"),
    ("x100D_a", "1 a"), ("a\xa0b", "a b"), ("a​b", "a b"), ("a　b", "a b"),
    ("Video Player clip", "clip"), ("Hello, World... again?!", "Hello, World again"),
    ("tab\there  x", "tab here"),
]


@pytest.mark.parametrize("value,expected", CLEAN_CASES)
def test_clean_text(spark, value, expected):
    assert one(spark, tx.clean_text(F.col("x")), value) == expected


def test_clean_text_literal_escape(spark):
    assert one(spark, tx.clean_text(F.col("x"), literal_escape=True), "line_x000D_next xD0") == "line next xD0"


def test_preprocess_title(spark):
    assert one(spark, tx.preprocess_title(F.col("x")), "News&keyword=abc&keyword=z") == "News"
    assert one(spark, tx.preprocess_title(F.col("x")), "plain") == "plain"
    assert one(spark, tx.preprocess_title(F.col("x")), None) is None


def test_truncate(spark):
    assert one(spark, tx.truncate(F.col("x")), "a" * 150) == "a" * 100
    assert one(spark, tx.truncate(F.col("x")), None) == ""


def test_normalize_for_score_keeps_unicode_words(spark):
    assert one(spark, tx.normalize_for_score(F.col("x")), " Héllo,  wörld! 가_나 ") == "Héllo wörld 가_나"


def test_oid_and_domain(spark):
    url = "https://n.news.naver.com/mnews/article/001/0012345?sid=1"
    assert one(spark, tx.oid_from_url(F.col("x")), url) == "001"
    assert one(spark, tx.oid_from_url(F.col("x")), "https://x.com/article/12/3") is None
    assert one(spark, tx.domain_key(F.col("x")), "https://www.YTN.co.kr/a") == "co.kr"
    assert one(spark, tx.domain_key(F.col("x")), "http://localhost/a") == "localhost"
    assert one(spark, tx.domain_key(F.col("x")), "not a url") == ""


def test_file_name_and_hyperlink(spark):
    df = spark.createDataFrame([(0, 'a/b:c*?"<>|d' + "x" * 60), (1233, "t")], "i long, t string")
    got = [r[0] for r in df.select(tx.safe_file_name("i", "t")).collect()]
    assert got == ["001_abcd" + "x" * 46 + ".txt", "1234_t.txt"]
    assert one(spark, tx.hyperlink(F.col("x")), "http://a") == '=HYPERLINK("http://a")'


def test_punctuation_links_mentions(spark):
    assert one(spark, tx.normalize_punctuation(F.col("x")), "a·b「c」‘d’“e”～❑") == "a/b<c>'d'\"e\"~-"
    assert one(spark, tx.delete_links(F.col("x")), "see http://x.y/z now") == "see  now"
    assert one(spark, tx.delete_mentions(F.col("x")), "hi @bob there") == "hi  there"


def test_hex(spark):
    assert one(spark, tx.char2hex(F.col("x")), "음") == "0xc74c"
    assert one(spark, tx.hex2char(F.col("x")), "c74c") == "음"
    assert one(spark, tx.hex2char(F.col("x")), "0xc74c") == "음"


def test_partition_array(spark):
    df = spark.createDataFrame([([1, 2, 3, 4, 5], [2, 4])], "a array<int>, i array<int>")
    assert df.select(tx.partition_array("a", "i")).collect()[0][0] == [[1, 2], [3, 4], [5]]


def test_round_half_even(spark):
    assert one(spark, tx.round_ratio(F.col("x")), 0.0625, "x double") == 0.062
    assert one(spark, tx.round_ratio(F.col("x")), 0.0635, "x double") == 0.064


def test_cleaner_steps_run_only_where_a_sign_stands(spark):
    """With and without the signs each text is cleaned as by all steps on all texts; a text without signs meets two classes only."""
    import random

    from pyspark.sql import functions as F

    from echotrace.functions import regex as R
    from echotrace.functions import text as tx

    rng = random.Random(12)
    bits = ["Video Player", "Video 태그를 지원하지 않는 브라우저입니다.", "12:34", "٠١:٢٣", ":", "1.25x", "0.٥٥x", "0.", "출처: x\ny", "출처:", "/ 12.5", "/", "ㅋㅎ", "ㅠ",
            "ㅜ", "!!", "~", "&amp;", "&#3;", "&", "_x000D_", " \n", "word", "é", "Video", "x"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 7))) for _ in range(400)] + [None, "NaN "]
    s = F.coalesce("t", F.lit("nan"))
    plain = s
    for pattern, repl in R.CLEAN_TEXT_STEPS:
        plain = F.regexp_replace(plain, pattern, repl)
    plain = tx.py_strip(F.regexp_replace(F.regexp_replace(plain, R.CLEAN_TEXT_CHARSET, " "), R.WS + "+", " "))
    plain = F.when(F.lower(tx.py_strip(s)) == "nan", "").otherwise(plain)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] == r[1] for r in df.select(tx.clean_text("t"), plain).collect())
    assert len(R.CLEAN_TEXT_SIGNS) == len(R.CLEAN_TEXT_STEPS)
