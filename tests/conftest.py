import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from echotrace.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="echotrace-tests")
    yield s


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]


def one(spark, col, value, schema="x string"):
    """Evaluate a Column function on one literal value."""
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col.alias("y")).collect()[0]["y"]
