"""Exact medians by group, with groups narrowed down and without."""

import random
import statistics

import pytest

from slatework.operators import aggregate as A
from slatework.plans import QuerySpec


def wanted(rows, i):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).extend([] if r[i] is None or r[i] != r[i] else [r[i]])
    return {k: statistics.median(v) if v else None for k, v in groups.items()}


@pytest.mark.parametrize("large,bins", [(10, 256), (50, 3), (10**6, 256), (0, 5)])
def test_narrowed_medians_equal_sorted_ones(spark, large, bins):
    r = random.Random(large + bins)
    rows = [(r.choice("aaaaabc") if i % 9 else None, r.choice([r.gauss(0, 1), r.gauss(0, 1e9), 5.0, None, float("nan")]), r.randrange(4)) for i in range(400)]
    rows += [("one", 3.5, None), ("none", None, 1), ("two", 1.0, 2), ("two", 2.0, 5)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    got = {r["g"]: (r["x"], r["y"]) for r in A.grouped_medians(df, "g", ["x", "y"], large, bins).collect()}
    assert got == {k: (v, wanted(rows, 2)[k]) for k, v in wanted(rows, 1).items()}


def test_infinities_and_extremes(spark):
    inf = float("inf")
    groups = {"a": [-inf, 1.0, 2.0], "b": [inf, inf, 1.0], "c": [-1.7e308, 1.7e308], "d": [1.7e308, 1.6e308], "e": [5e-324, 0.0, 1e-323], "f": [inf, 3.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["x"] for r in A.grouped_medians(df, "g", ["x"], 1).collect()}
    assert got == pytest.approx({"a": 1.0, "b": inf, "c": 0.0, "d": 1.65e308, "e": 5e-324, "f": inf}, rel=1e-12, abs=0)


def test_a_large_group_s_values_are_counted_before_the_shuffle(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("if(id % 4 = 0, id % 50, -1) as g", "cast(id as double) as x").repartition(4)
    monkeypatch.setattr(A, "LARGE_GROUP", 1000)
    result = A.run_query(df, QuerySpec("g", "x", "median", limit=5, group_others=True))
    got = {r["g"]: r["x"] for r in result.df.collect()}
    rest = [i for i in range(20_000) if i % 4 == 0]
    assert got["-1"] == statistics.median([i for i in range(20_000) if i % 4]) and len(got) == 5
    kept = {int(k) for k in got if k not in ("Others", "-1")}
    assert got["Others"] == statistics.median([i for i in rest if i % 50 not in kept])
    plan = A._narrowed(df.selectExpr("g as _k", "x as v"), 64, 10)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan or "partial_min" in plan
    assert "percentile" not in plan
