"""Every query against its SQL twin on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from emberline.plans import catalogue

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.QUERIES, catalogue.SQL


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["fire_id", "day", "bin"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    diffs, _ = compare(QUERIES[name](spark, SF_DIR), con, SQL[name])
    assert not diffs, "\n".join(diffs)
