"""Filters, aggregates, Top-N, resampling, drill-down, profiles and reports on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from slatework.functions.text import display_value, title
from slatework.operators import aggregate as A
from slatework.operators import drill, profile, report
from slatework.operators.filters import apply_filters, compile_filters
from slatework.plans import Filter, QuerySpec
from slatework.sources import tables


@pytest.fixture(scope="module")
def edge(spark):
    rows = [("a", 5.0, 1), ("a", None, 2), ("b", 7.0, 3), ("Others", 1.0, 4), (None, 9.0, 5), ("c", 2.0, 6), ("d", 2.0, 7), ("e", None, 8)]
    return spark.createDataFrame(rows, "k string, v double, n int")


def result(df, *args, **more):
    out = A.run_query(df, QuerySpec(*args, **more))
    return [tuple(r) for r in out.df.collect()], out


def test_sum_of_nothing_is_zero_and_null_groups_go(edge):
    rows, _ = result(edge, "k", "v")
    assert dict(rows) == {"a": 5.0, "b": 7.0, "Others": 1.0, "c": 2.0, "d": 2.0, "e": 0.0}
    assert [k for k, _ in rows][:2] == ["b", "a"]


def test_mean_of_nothing_is_zero_in_results(edge):
    assert dict(result(edge, "k", "v", "mean")[0])["e"] == 0.0


def test_count_counts_rows_once(edge):
    assert dict(result(edge, "k", "v", "count")[0])["a"] == 1


def test_top_n_breaks_ties_by_label_and_takes_nulls_into_others(edge):
    rows, out = result(edge, "k", "v", limit=3, group_others=True)
    # 'Others' as a value of its own is not among the kept: it is in the bucket as well
    assert dict(rows) == {"b": 7.0, "a": 5.0, "Others": 14.0}
    assert {r[0] for r in out.kept.collect()} == {"a", "b"}


def test_null_alone_makes_no_bucket(edge):
    assert dict(result(edge.filter("k is null or k in ('a', 'b')"), "k", "v", limit=5, group_others=True)[0]) == {"a": 5.0, "b": 7.0}
    assert dict(result(edge.filter("k is null or k in ('a', 'b')"), "k", "v", "median", limit=5, group_others=True)[0]) == {"a": 5.0, "b": 7.0}


def test_median_bucket(edge):
    assert dict(result(edge, "k", "v", "median", limit=3, group_others=True)[0]) == {"b": 7.0, "a": 5.0, "Others": 2.0}


def test_one_row_is_the_top_item(edge):
    assert result(edge, "k", "v", limit=1, group_others=True)[0] == [("b", 7.0)]


def test_text_ranks_by_count(edge):
    rows, _ = result(edge.withColumn("t", F.col("k")), "k", "t", "count", limit=2, group_others=True)
    assert dict(rows) == {"a": 2, "Others": 5}


def test_x_among_ys_keeps_its_label(edge):
    rows, out = result(edge, "n", ("n", "v"), limit=2)
    assert out.ys == ("n_sum", "v") and rows[0][0] == "8"


def test_limits_and_validation(edge):
    for spec in (dict(x="k", ys=("zz",)), dict(x="zz", ys=("v",))):
        with pytest.raises(ValueError, match="no such columns"):
            A.run_query(edge, QuerySpec(**spec))
    for bad in (dict(aggregation="mode"), dict(sort_by="x")):
        with pytest.raises(ValueError):
            QuerySpec("k", ("v",), **bad)
    with pytest.raises(ValueError, match="negative"):
        QuerySpec("k", ("v",), limit=-1).rows()
    assert QuerySpec("k", ("v",), limit=0).rows()[0] == QuerySpec("k", ("v",), limit=501).rows()[0] == 500
    assert QuerySpec("k", ("v",)).rows() == (50, None)
    with pytest.raises(ValueError, match="needs numbers"):
        A.run_query(edge, QuerySpec("n", ("k",)))
    assert result(edge, "k", "v", limit=2)[1].capped() and not result(edge, "k", "v")[1].capped()


def test_identifiers_are_counted(edge):
    out = A.run_query(edge, QuerySpec("k", ("n",)), {"n": "identifier"})
    assert dict(tuple(r) for r in out.df.collect())["a"] == 2 and out.y_label == "Count of Records" and out.notes


def days(spark, n, step=1):
    start = dt.datetime(2020, 1, 1, 12)
    return spark.createDataFrame([(start + dt.timedelta(days=i * step), float(i)) for i in range(n)] + [(None, 1.0)], "d timestamp, v double")


def test_periods_follow_the_range(spark):
    assert result(days(spark, 101), "d", "v")[1].period == "week"
    assert result(days(spark, 200), "d", "v")[1].period == "month"
    out = result(days(spark, 800), "d", "v")
    assert out[1].period == "year" and [k for k, _ in out[0]] == ["2020", "2021", "2022"]
    rows, plain = result(days(spark, 100), "d", "v", limit=500)
    assert plain.period is None and rows[0][0] == "2020-01-01 12:00:00" and len(rows) == 100


def test_week_labels_run_from_monday(spark):
    rows, out = result(days(spark, 120), "d", "v", "count")
    assert rows[0] == ("2019-12-30/2020-01-05", 5) and out.x == "d_week"
    df = days(spark, 120)
    assert drill.drill_from_point(df, QuerySpec("d", ("v",)), out, rows[0][0]).count() == 5


def test_midnights_are_printed_as_days(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0)], "d timestamp, v double")
    assert result(df, "d", "v")[0] == [("2020-01-01", 1.0)]


def test_filters_are_typed_and_null_never_matches(edge):
    def keys(*filters):
        return sorted(r["n"] for r in apply_filters(edge, filters)[0].collect())

    assert keys(Filter("v", "eq", "2")) == [6, 7]
    assert keys(Filter("k", "eq", "None")) == []
    assert keys(Filter("n", "eq", "x")) == keys(Filter("n", "eq", 1.5)) == []
    assert keys(Filter("k", "contains", "OTH")) == [4]
    assert keys(Filter("n", min_val=3, max_val="4")) == [3, 4]
    assert keys(Filter("v", "gt", "much")) == list(range(1, 9))
    assert keys(Filter("k", values=("a", "b")), Filter("v", "gte", 6)) == [3]
    assert keys(Filter("k", "contains", "a%")) == []


def test_text_is_compared_as_numbers(spark):
    df = spark.createDataFrame([("10",), ("9",), ("x",), (None,)], "t string")
    assert [r[0] for r in apply_filters(df, [Filter("t", "gt", 9)])[0].collect()] == ["10"]


def test_skips_are_noted_or_raised(edge):
    assert compile_filters(edge, [Filter("zz", "eq", 1), Filter("k", "like", "a"), Filter("k", "eq", None)])[0] is None
    for f in (Filter("zz", "eq", 1), Filter("k", "like", "a"), Filter("k", "eq", None)):
        with pytest.raises(ValueError):
            compile_filters(edge, [f], strict=True)


def test_filters_reach_the_scan(spark, edge, tmp_path):
    path = str(tmp_path / "t.parquet")
    edge.write.parquet(path)
    df = apply_filters(spark.read.parquet(path), [Filter("n", "eq", "3"), Filter("v", "gt", 1)])[0]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(n,3)" in plan and "GreaterThan(v,1.0)" in plan


def test_spec_filters_merge_and_replace(edge):
    spec = QuerySpec("k", ("v",), filters=(Filter("n", "gt", 1), Filter("k", "eq", "a"))).with_filter(Filter("n", "lt", 3))
    assert [(f.column, f.operator) for f in spec.filters] == [("k", "eq"), ("n", "lt")]
    more = spec.merge([{"column": "v", "operator": "gt", "value": 0}, {"operator": "gt"}, {"column": "v", "value": [1]}, {"column": "k", "values": ["a"]}], edge)
    assert len(more.filters) == 4
    for bad in ({"column": "zz"}, {"column": "v", "operator": "like"}):
        with pytest.raises(ValueError):
            spec.merge([bad], edge)


def test_drilldown_counts_all_and_keeps_nulls(edge):
    rows, total = drill.drilldown(edge, [Filter("n", "gt", 1)], ["n"], limit=3)
    assert [r["v"] for r in rows.collect()] == [None, 7.0, 1.0] and total.first()[0] == 7


def test_drill_from_the_bucket(edge):
    spec = QuerySpec("k", ("v",), limit=3, group_others=True)
    rows = drill.drill_from_point(edge, spec, A.run_query(edge, spec), "Others")
    assert sorted(r["n"] for r in rows.collect()) == [4, 5, 6, 7, 8]


def test_shares_and_pages(edge):
    df = A.share_of_total(A.run_query(edge, QuerySpec("k", ("v",))).df, "v")
    assert sum(r["share"] for r in df.collect()) == pytest.approx(1)
    assert [r["n"] for r in A.page(edge, ["n"], 1, 3).collect()] == [4, 5, 6]


def test_meanings():
    from pyspark.sql import types as T

    kinds = [profile.semantic_type(n, k, d, 100) for n, k, d in [("at", T.TimestampType(), 5), ("birthday", T.StringType(), 5), ("zip_code", T.LongType(), 90), ("paid", T.DoubleType(), 3), ("x", T.DoubleType(), 51), ("x", T.DoubleType(), 19), ("x", T.DoubleType(), 20), ("t", T.StringType(), 49), ("t", T.StringType(), 50)]]
    assert kinds == ["temporal", "temporal", "identifier", "identifier", "metric", "categorical", "metric", "categorical", "identifier"]


def test_profile_estimates_are_exact_near_thresholds(spark):
    df = spark.range(1000).selectExpr("id % 20 as a", "id % 19 as b", "cast(id % 50 as string) as c")
    rows = {r["name"]: r for r in profile.column_profile(df, exact=False).collect()}
    assert [rows[c]["semantic_type"] for c in "abc"] == ["metric", "categorical", "identifier"]
    assert rows["a"]["unique_count"] == 20 and len(rows["c"]["sample_values"]) == 20


def test_default_request_and_summary(spark, edge):
    p = profile.column_profile(edge.selectExpr("k", "v * 1000 + n as v"))
    assert profile.default_spec(p) == QuerySpec("k", ("v",))
    assert profile.default_spec(p.filter("name = 'k'")) is None
    found = profile.profile(edge, {"v": "metric"})
    assert found["rows"] == 8 and found["metrics"].first()["total"] == 26.0 and found["time_range"] is None


def test_report_round_trip(spark, edge, tmp_path):
    specs = {"one": QuerySpec("k", ("v", "n")), "two": QuerySpec("n", ("v",), limit=2)}
    long = report.build_report(edge, specs)
    report.write_report(long, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).groupBy("widget").count().orderBy("widget").collect() == [("one", 12), ("two", 2)]


def test_shapes(spark, edge):
    assert report.to_chart_shape(edge).ys == ("v", "n")
    assert report.to_chart_shape({"a": 1}, spark).df.collect() == [("a", 1.0)]
    assert report.to_chart_shape(3, spark).df.first()[1] == "3"
    assert report.transform(edge, lambda d: d.select("n"), (Filter("n", "lt", 3),)).count() == 2


def test_display(spark):
    df = spark.createDataFrame([(1234567.0,), (-1500.0,), (12.5,), (None,)], "x double")
    shown = df.select(display_value(F.col("x"), "currency", True), display_value(F.col("x")), display_value(F.col("x"), "percentage"), display_value(F.col("x"), "currency"), title(F.lit("a_bc")))
    assert [tuple(r) for r in shown.collect()][0] == ("$1.2M", "1,234,567", "123456700.0%", "$1,234,567", "A Bc")
    assert [r[0] for r in shown.collect()] == ["$1.2M", "-$1.5K", "$12", None]
    assert [r[1] for r in shown.collect()] == ["1,234,567", "-1,500", "12.5", None]


def test_compact_currency_that_rounds_up_to_a_thousand_has_no_comma(spark, tmp_path):
    import duckdb

    from slatework import catalog

    df = spark.createDataFrame([(999.49,), (999.5,), (999.99,), (1000.0,), (-999.7,), (999999.99,)], "x double")
    assert [r[0] for r in df.select(display_value(F.col("x"), "currency", True)).collect()] == ["$999", "$1000", "$1000", "$1.0K", "-$1000", "$1000.0K"]
    assert [r[0] for r in df.select(display_value(F.col("x"), "currency")).collect()][1:4] == ["$1,000", "$1,000", "$1,000"]
    path = str(tmp_path / "lineitem.parquet")
    # every cent about the ends of the scales
    cents = spark.range(99_000, 101_000).union(spark.range(99_994_000, 100_006_000))
    cents.selectExpr("id as l_orderkey", "1 as l_linenumber", "id / 100 as l_extendedprice", "id % 11 / 100 as l_discount").write.parquet(path)
    ours = catalog.QUERIES["display_values"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/*.parquet'")
    wanted = con.sql(f"SELECT {', '.join(ours.columns)} FROM ({catalog.SQL['display_values']})").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(wanted)


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Name,Amount,Amount,When\nx,$5,1,2021-01-02\ny,NA,2,2021-01-03\n")
    done = tables.ingest(spark, str(path))
    assert done.df.columns == ["name", "amount", "amount_2", "when"]
    assert [tuple(map(str, r)) for r in done.df.collect()] == [("x", "5.0", "1", "2021-01-02 00:00:00"), ("y", "None", "2", "2021-01-03 00:00:00")]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "t.txt"))
    tables.register(done.df, "sales")
    assert tables.dataset(spark, "sales").count() == 2
    with pytest.raises(KeyError):
        tables.dataset(spark, "nothing")
    rows, total = tables.preview(done.df, 1)
    assert rows.count() == 1 and total.first()[0] == 2


def test_summary_stats(edge):
    row = A.summary_stats(edge, ["v", "n"]).first()
    assert row["stddev_v"] > 0 and -1 <= row["corr_v_n"] <= 1


def test_times_are_read_once(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(3000).selectExpr("timestamp'2020-01-01' + make_interval(0, 0, 0, id % 500, id % 24) as ts", "cast(id as double) as v", "cast(id as string) as s").write.parquet(path)
    df = spark.read.parquet(path)
    for how in ("sum", "count", "mean", "min", "max"):
        result = A.run_query(df, QuerySpec("ts", "v", how))
        assert result.period == "month" and not any(path in f for f in result.df.inputFiles())
    want = {r["k"]: r["v"] for r in df.selectExpr("date_format(ts, 'yyyy-MM') as k", "v").groupBy("k").agg(F.avg("v").alias("v")).collect()}
    got = {r["ts_month"]: r["v"] for r in A.run_query(df, QuerySpec("ts", "v", "mean")).df.collect()}
    assert got == pytest.approx(want)
    most = {r["k"]: r["s"] for r in df.selectExpr("date_format(ts, 'yyyy-MM') as k", "s").groupBy("k").agg(F.max("s").alias("s")).collect()}
    assert {r["ts_month"]: r["s"] for r in A.run_query(df, QuerySpec("ts", ("v", "s"), "max")).df.collect()} == most


@pytest.mark.parametrize("times,resampled", [(100, False), (101, True), (90, False), (120, True)])
def test_few_times_within_days_are_counted(spark, times, resampled):
    df = spark.range(1000).selectExpr(f"timestamp'2020-01-01' + make_interval(0, 0, 0, id % 3, 0, id % {times}) as ts", "1.0 as v")
    n = df.distinct().count()
    result = A.run_query(df, QuerySpec("ts", "v"))
    assert (result.period is not None) == (n > 100)
    assert sum(r["v"] for r in result.df.collect()) == 1000 or not resampled


def test_reports_share_a_scan(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(2000).selectExpr("concat('k', id % 7) as k", "id % 3 as n", "timestamp'2019-01-01' + make_interval(0, 0, 0, id) as ts", "cast(id as double) as v", "if(id % 5 = 0, null, id) as w").write.parquet(path)
    df = spark.read.parquet(path)
    odd = (Filter("n", "eq", 1),)
    specs = {"a": QuerySpec("k", ("v", "w")), "b": QuerySpec("n", "v", "mean"), "c": QuerySpec("ts", "w", "count"), "d": QuerySpec("ts", "v", "max"), "e": QuerySpec("k", "w", "min", filters=odd, limit=3), "f": QuerySpec("k", "v", "median"), "g": QuerySpec("n", "n", "sum", filters=odd)}
    got = report.build_report(df, {k: specs[k] for k in "abcd"})
    assert not any(path in f for f in got.inputFiles())
    together = sorted(tuple(r) for r in report.build_report(df, specs).collect())
    alone = sorted(tuple(r) for k, s in specs.items() for r in report.build_report(df, {k: s}).collect())
    assert together == alone and {r[0] for r in together} == set(specs)


@pytest.mark.parametrize("order", [["a", "id"], ["-a", "id"], ["b", "-id"], ["-b", "a", "id"]])
def test_pages_after_a_key_are_the_pages(spark, order):
    df = spark.range(57).selectExpr("id", "if(id % 4 = 0, null, id % 5) as a", "if(id % 6 = 0, null, concat('x', id % 3)) as b").repartition(3)
    last, seen = None, []
    while True:
        found = A.page_after(df, order, last, 10)
        rows = found.collect()
        if not rows:
            break
        seen += rows
        last = A.cursor(found, order)
    keys = [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_first(c) for c in order]
    assert seen == df.orderBy(*keys).collect()


def test_a_page_s_key_reaches_the_scan(spark, tmp_path):
    path = f"{tmp_path}/t.parquet"
    spark.range(1000).selectExpr("id", "id % 9 as a").write.parquet(path)
    found = A.page_after(spark.read.parquet(path), ["a", "id"], (4, 500))
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(a,4)" in plan and "TakeOrderedAndProject" in plan
