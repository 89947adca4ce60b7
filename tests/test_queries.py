"""Every query with SQL against DuckDB on the smallest tables."""

import os

import pytest

from tests import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_equal_sql(spark):
    assert compare.run(spark, SF) == {}


def test_entry(spark):
    import __spark_entry__ as e

    assert "lang" in e.entry(spark).columns
    assert set(e.oracle_sql()) <= set(e.queries())
