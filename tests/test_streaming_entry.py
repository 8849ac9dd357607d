"""Streaming cleaning and the driver contract."""

import os

import pytest

import __spark_entry__ as E
from echotrace.plans import clean
from echotrace.sources.readers import POST_SCHEMA
from echotrace.streaming.clean_stream import start_clean_stream


def test_clean_stream(spark, tmp_path):
    src = tmp_path / "in"
    rows = [(1, "t", None, "소식 발표했다.", "소식", "a", None), (2, "t", None, "no keyword", "소식", "a", None)]
    spark.createDataFrame(rows, POST_SCHEMA).write.parquet(str(src))
    q = start_clean_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), POST_SCHEMA,
                           clean.CleanParams())
    q.awaitTermination(120)
    assert [r["idx"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [1]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/documents.parquet"), reason="no test data")
def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.columns == ["idx", "article_link", "copy_ratio"]
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
