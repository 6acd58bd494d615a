"""Every registered query with SQL must give the SQL's rows; every other one must run."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", list(SQL))
def test_rows_equal_sql(spark, con, key):
    ok, note = compare(QUERIES[key](spark, SF), con, SQL[key])
    assert ok, note


@pytest.mark.parametrize("key", [k for k in QUERIES if k not in SQL])
def test_runs(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["item_id", "place", "doc_id", "uri", "passage", "start_char"] and df.count() > 0
