"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry_points


def test_sql_is_for_registered_queries():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_flagship_query_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["o_orderpriority", "o_totalprice"] and df.count() > 0
