"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest
from compare import connect, difference, oracle_rows, spark_rows

from tablewright.suite import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, sf, con, key):
    got = spark_rows(QUERIES[key](spark, sf))
    assert difference(got, oracle_rows(con, ORACLES[key])) is None


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 120


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert {r["column_name"] for r in rows} == {"o_totalprice", "c_acctbal", "c_nationkey"}


def test_streams_equal_batches(spark, sf):
    from tablewright.suite.registry import table

    streamed = QUERIES["stream_predict"](spark, sf)
    assert streamed.count() == table(spark, sf, "lineitem").count()
    assert streamed.where("prediction IS NULL").count() == 0
