import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from hemline.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted plain tuples of a DataFrame."""

    def take(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return take


@pytest.fixture
def one(spark):
    """Value of a column expression over one text."""
    from pyspark.sql import functions as F

    def value(fn, text):
        df = spark.createDataFrame([(text,)], "c string")
        return df.select(fn(F.col("c")).alias("v")).first()["v"]

    return value
