"""Pluggable tokenizer (X1), stop words (F9) and the input guard."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from echotrace.functions import tokens as tk
from echotrace.operators import score


def test_default_and_word_tokenizers(spark):
    df = spark.createDataFrame([("Hello,  World! the x",)], "t string")
    r = df.select(tk.score_tokens("t", stopwords=["the"]).alias("a"),
                  tk.word_tokens(F.lower(F.col("t"))).alias("b")).first()
    assert r["a"] == ["hello", "world", "x"]
    assert r["b"] == ["hello", "world", "the", "x"]


def test_pandas_udf_tokenizer(spark):
    def bigrams(s: pd.Series) -> pd.Series:     # nested: shipped to the workers by value
        return s.map(lambda t: [t[i:i + 2] for i in range(len(t) - 1)] if t else [])
    char_bigrams = pandas_udf(bigrams, "array<string>")
    df = spark.createDataFrame([("p", "abcd", "abce")], "pair_id string, article string, post string")
    r = score.copy_ratio(df, tokenizer=char_bigrams).first()
    assert 0.0 < r["cosine"] < 1.0


def test_stopword_rows_and_long_lists(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a")], "id int, token string")
    stop = spark.createDataFrame([("a",)], "w string")
    assert [r["token"] for r in tk.remove_stopwords_rows(rows, stop).collect()] == ["b"]
    arr = spark.createDataFrame([(["a", "b", "77"],)], "x array<string>")
    many = [str(i) for i in range(20_000)] + ["a"]
    assert arr.select(tk.remove_stopwords(F.col("x"), many).alias("y")).first()["y"] == ["b"]


def test_require_string(spark):
    df = spark.createDataFrame([(1, "a")], "n int, s string")
    assert tk.require_string(df, "s") is df
    with pytest.raises(TypeError):
        tk.require_string(df, "n")


def test_table_tokenizer_takes_many_texts_without_a_shuffle(spark):
    """texts are cut where they are, many a call; repeated and null ids and null texts."""
    from pyspark.sql import functions as F

    from echotrace.functions.tokens import tokens_by_table
    from echotrace.plans.catalog import first_letters

    rows = [(i % 300, f"word{i} abcdefgh") for i in range(700)] + [(None, "x"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    out = tokens_by_table(df, "id", F.col("text"), first_letters)
    want = [(i, p, w[:5]) for i, t in rows for p, w in enumerate((t or "").split())]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_texts_cut_at_once_have_the_default_tokens(spark):
    """Stop words, repeats, marks, unusual white space, empty and null texts, over a slice that starts inside an array."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from echotrace.functions import tokens

    texts = ["x", "The cat, the HAT 　sat", "", None, " \x1c a b\x85c ", "...", "the of", "İ I a_b ß ́e 한국 the", "a  a\ta"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    rows = df.select("i", tokens.score_tokens("t", None, ["the", "of"]).alias("w"), tokens.score_text("t").alias("s")).orderBy("i").collect()
    cut = tokens.cut_words(pa.array([r["s"] for r in rows], pa.string()).slice(1), ["the", "of"])
    assert cut.to_pylist() == [r["w"] for r in rows[1:]] and cut.to_pylist()[0] == ["cat", "hat", "sat"]
    assert tokens.cut_words(pa.array([], pa.string())).to_pylist() == [] and tokens.cut_words(pa.array([None, ""], pa.string())).to_pylist() == [[], []]
