"""Every query against its oracle SQL on the smallest provided tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare
from checks.registry import ORACLES, QUERIES

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    fn = entry._prepared(QUERIES[name])
    if name in ORACLES:
        assert compare(spark, SF, fn, ORACLES[name]) == ""
    else:
        assert fn(spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["category", "filename", "key_id"]
    assert df.count() > 0
