"""Every registered query against its SQL, and what the plans look like."""

import os

import pytest

from slatework import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    for name in ("customer", "part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con



@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_and_sql_agree(spark, con, name):
    ours = catalog.QUERIES[name](spark, SF)
    names = sorted(ours.columns)
    theirs = con.sql(catalog.SQL[name])
    assert names == sorted(theirs.columns)
    wanted = theirs.project(", ".join(f'"{c}"' for c in names)).fetchall()

    def key(r):
        return tuple((x is None, str(round(x, 6)) if isinstance(x, float) else str(x)) for x in r)

    assert sorted(map(key, wanted)) == sorted(key(r) for r in ours.select(*names).collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_no_query_runs_python_on_rows(spark):
    for name in ("topn_others_mean", "resample_week", "repair_dates_us", "display_values"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan
