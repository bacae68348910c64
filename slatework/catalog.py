"""The registered queries of the table operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.functions.text import display_value, title
from slatework.operators import aggregate, clean, drill, profile, report, stats
from slatework.operators.filters import apply_filters
from slatework.plans import Filter, QuerySpec
from slatework.sources import statistics, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__], SQL[fn.__name__] = fn, sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    """Doubles rounded, as sums depend on the order of their terms; whole numbers as bigint."""
    out = {f.name: F.round(F.col(f"`{f.name}`"), digits) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    out |= {f.name: F.col(f"`{f.name}`").cast("long") for f in df.schema.fields if isinstance(f.dataType, T.IntegerType)}
    return df.withColumns(out) if out else df


def asked(df: DataFrame, x: str, ys: str | tuple[str, ...], digits: int = 2, types: dict[str, str] | None = None, **more) -> DataFrame:
    return rounded(aggregate.run_query(df, QuerySpec(x, ys, **more), types).df, digits)


# Aggregates


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def agg_sum_by_category(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", filters=(Filter("o_orderstatus", "eq", "F"),), sort_by="value")


@query("SELECT o_orderpriority, round(avg(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def agg_mean(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", aggregation="mean")


@query("SELECT o_orderpriority, round(median(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def agg_median(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", aggregation="median")


@query("""SELECT l_returnflag, round(median(l_extendedprice), 4) AS l_extendedprice, round(median(CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END), 4) AS l_tax FROM lineitem GROUP BY 1""")
def agg_median_of_large_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))
    return rounded(aggregate.grouped_medians(lines, "l_returnflag", ["l_extendedprice", "l_tax"], large=1000), 4)


@query("SELECT o_orderpriority, count(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def agg_count(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", aggregation="count")


@query("SELECT o_orderpriority, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def agg_min(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", aggregation="min")


@query("SELECT o_orderpriority, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def agg_max(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", aggregation="max")


@query("SELECT o_orderstatus, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY 1")
def agg_min_text(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", aggregation="min")


@query("""SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity, round(sum(l_extendedprice), 2) AS l_extendedprice,
round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY 1""")
def agg_multi_y(spark, sf_dir):
    return asked(table(spark, sf_dir, "lineitem"), "l_returnflag", ("l_quantity", "l_extendedprice", "l_tax"))


@query("SELECT o_orderpriority, count(o_custkey) AS o_custkey FROM orders GROUP BY 1")
def enforce_count_identifier(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return asked(orders, "o_orderpriority", "o_custkey", types={"o_custkey": "identifier"})


@query("""SELECT l_returnflag, round(coalesce(sum(CASE WHEN l_returnflag <> 'R' AND l_orderkey % 7 <> 0 THEN l_tax END), 0), 2) AS l_tax
FROM lineitem GROUP BY 1""")
def agg_null_to_zero(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("l_tax", F.when((F.col("l_returnflag") != "R") & (F.col("l_orderkey") % 7 != 0), F.col("l_tax")))
    return asked(lines, "l_returnflag", "l_tax")


# Filters


def _matching(spark, sf_dir, name: str, columns: list[str], *filters: Filter) -> DataFrame:
    return rounded(apply_filters(table(spark, sf_dir, name), filters)[0].select(*columns))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand = 'Brand#12'")
def filter_eq(spark, sf_dir):
    return _matching(spark, sf_dir, "part", ["p_partkey", "p_brand"], Filter("p_brand", "eq", "Brand#12"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 370")
def filter_eq_number(spark, sf_dir):
    return _matching(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"], Filter("o_custkey", "eq", "370.0"))


@query("SELECT p_partkey, p_type FROM part WHERE contains(lower(p_type), lower('Eco'))")
def filter_contains(spark, sf_dir):
    return _matching(spark, sf_dir, "part", ["p_partkey", "p_type"], Filter("p_type", "contains", "Eco"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_totalprice > 250000")
def filter_gt(spark, sf_dir):
    return _matching(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"], Filter("o_totalprice", "gt", "250000"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_totalprice < 5000.5")
def filter_lt(spark, sf_dir):
    return _matching(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"], Filter("o_totalprice", "lt", 5000.5))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size >= 40")
def filter_gte(spark, sf_dir):
    return _matching(spark, sf_dir, "part", ["p_partkey", "p_size"], Filter("p_size", "gte", 40))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size <= 3")
def filter_lte(spark, sf_dir):
    return _matching(spark, sf_dir, "part", ["p_partkey", "p_size"], Filter("p_size", "lte", 3))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09 12:30:00'""")
def filter_datetime_range(spark, sf_dir):
    found = apply_filters(table(spark, sf_dir, "events"), [Filter("ts", min_val="2024-01-05", max_val="2024-01-09 12:30:00")])[0]
    return found.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-30'")
def filter_datetime_gt(spark, sf_dir):
    found = apply_filters(table(spark, sf_dir, "orders"), [Filter("o_orderdate", "gt", "06/30/2000")])[0]
    return found.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#11', 'Brand#34', 'Brand#99')")
def filter_in_list(spark, sf_dir):
    return _matching(spark, sf_dir, "part", ["p_partkey", "p_brand"], Filter("p_brand", values=("Brand#11", "Brand#34", "Brand#99")))


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 100000 AND o_totalprice <= 200000 AND contains(lower(o_orderpriority), 'urgent')""")
def filter_conjunction(spark, sf_dir):
    wanted = (Filter("o_orderstatus", values=("F", "O")), Filter("o_totalprice", min_val=100000, max_val=200000), Filter("o_orderpriority", "contains", "urgent"))
    return _matching(spark, sf_dir, "orders", ["o_orderkey", "o_totalprice"], *wanted)


@query("""SELECT o_orderkey, price FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'unknown' ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price FROM orders)
WHERE TRY_CAST(price AS DOUBLE) > 200000""")
def filter_text_numeric(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 9 == 0, "unknown").otherwise(F.floor("o_totalprice").cast("string"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", price.alias("price"))
    return apply_filters(found, [Filter("price", "gt", 200000)])[0]


# Top-N


def _bucketed(how: str) -> str:
    return f"""WITH r AS (SELECT l_suppkey AS k, sum(l_quantity) AS s FROM lineitem GROUP BY 1),
t AS (SELECT k FROM r ORDER BY s DESC, k LIMIT (SELECT CASE WHEN count(*) > 20 THEN 19 ELSE 20 END FROM r))
SELECT CASE WHEN l_suppkey IN (SELECT k FROM t) THEN CAST(l_suppkey AS VARCHAR) ELSE 'Others' END AS l_suppkey, {how} AS l_quantity
FROM lineitem GROUP BY 1"""


def _top_suppliers(spark, sf_dir, how: str) -> DataFrame:
    return asked(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", aggregation=how, limit=20, group_others=True)


@query(_bucketed("round(sum(l_quantity), 2)"))
def topn_others_sum(spark, sf_dir):
    return _top_suppliers(spark, sf_dir, "sum")


@query(_bucketed("round(avg(l_quantity), 2)"))
def topn_others_mean(spark, sf_dir):
    return _top_suppliers(spark, sf_dir, "mean")


@query(_bucketed("count(l_quantity)"))
def topn_others_count(spark, sf_dir):
    return _top_suppliers(spark, sf_dir, "count")


@query(_bucketed("round(median(l_quantity), 2)"))
def topn_others_median(spark, sf_dir):
    return _top_suppliers(spark, sf_dir, "median")


@query(_bucketed("max(l_quantity)"))
def topn_others_max(spark, sf_dir):
    return _top_suppliers(spark, sf_dir, "max")


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 13 <> 0 THEN p_brand END AS b, p_retailprice AS v FROM part),
t AS (SELECT b FROM p WHERE b IS NOT NULL GROUP BY 1 ORDER BY sum(v) DESC, b LIMIT 7)
SELECT CASE WHEN b IN (SELECT b FROM t) THEN b ELSE 'Others' END AS p_brand, round(sum(v), 2) AS p_retailprice FROM p GROUP BY 1""")
def topn_others_null_label(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_partkey") % 13 != 0, F.col("p_brand")))
    return asked(part, "p_brand", "p_retailprice", limit=8, group_others=True)


@query("SELECT p_brand, round(avg(p_retailprice), 2) AS p_retailprice FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 10")
def topn_no_others(spark, sf_dir):
    return asked(table(spark, sf_dir, "part"), "p_brand", "p_retailprice", aggregation="mean", limit=10)


# Dates


@query("SELECT strftime(o_orderdate, '%Y') AS o_orderdate_year, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def resample_year(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS o_orderdate_month, round(avg(o_totalprice), 2) AS o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1997-12-31' GROUP BY 1""")
def resample_month(spark, sf_dir):
    year = Filter("o_orderdate", min_val="1997-01-01", max_val="1997-12-31")
    return asked(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", aggregation="mean", filters=(year,))


@query("""SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') || '/' || strftime(date_trunc('week', ts) + INTERVAL 6 DAY, '%Y-%m-%d') AS ts_week,
round(sum(value), 2) AS value FROM events GROUP BY 1""")
def resample_week(spark, sf_dir):
    return asked(table(spark, sf_dir, "events"), "ts", "value")


@query("SELECT strftime(o_orderdate, '%Y') AS o_orderdate_year, count(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def resample_count(spark, sf_dir):
    return asked(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", aggregation="count")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(sum(value), 2) AS value FROM events GROUP BY 1")
def dates_not_resampled(spark, sf_dir):
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("day"), "value")
    return asked(days, "day", "value")


# Order, limits, shares


@query("SELECT CAST(c_nationkey AS VARCHAR) AS c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal FROM customer GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def sort_label_limit(spark, sf_dir):
    return asked(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", limit=10, sort_by="label")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10 OFFSET 10")
def page_of_result(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return aggregate.page(counts, [F.desc("n"), "p_brand"], 1)


@query("""SELECT o_orderpriority, round(sum(o_totalprice), 2) AS o_totalprice, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (), 6) AS share
FROM orders GROUP BY 1""")
def share_of_total(spark, sf_dir):
    result = aggregate.run_query(table(spark, sf_dir, "orders"), QuerySpec("o_orderpriority", "o_totalprice"))
    shares = aggregate.share_of_total(result.df, "o_totalprice")
    return shares.select("o_orderpriority", F.round("o_totalprice", 2).alias("o_totalprice"), F.round("share", 6).alias("share"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def page_after_key(spark, sf_dir):
    orders, order, last = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], None
    for _ in range(3):
        last = aggregate.cursor(aggregate.page_after(orders, order, last), order)
    return aggregate.page_after(orders, order, last)


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey, o_orderkey LIMIT 50 OFFSET 50""")
def drilldown_next_rows(spark, sf_dir):
    orders, order, wanted = table(spark, sf_dir, "orders"), ["o_custkey", "o_orderkey"], [Filter("o_orderstatus", "eq", "F")]
    last = aggregate.cursor(drill.drilldown(orders, wanted, order)[0], order)
    return drill.drilldown(orders, wanted, order, last=last)[0].select("o_orderkey", "o_custkey")


# Drill-down


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
def drilldown_rows(spark, sf_dir):
    wanted = [Filter("o_totalprice", "gt", 150000), Filter("o_orderstatus", "eq", "F")]
    return drill.drilldown(table(spark, sf_dir, "orders"), wanted, ["o_orderkey"])[0].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("SELECT count(*) AS total FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def drilldown_total(spark, sf_dir):
    wanted = [Filter("o_totalprice", "gt", 150000), Filter("o_orderstatus", "eq", "F")]
    return drill.drilldown(table(spark, sf_dir, "orders"), wanted, ["o_orderkey"])[1]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def drill_from_period(spark, sf_dir):
    orders, spec = table(spark, sf_dir, "orders"), QuerySpec("o_orderdate", "o_totalprice")
    result = aggregate.run_query(orders, spec)
    return drill.drill_from_point(orders, spec, result, "1997").select("o_orderkey", "o_totalprice")


@query("""WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 4)
SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN (SELECT p_brand FROM t)""")
def drill_from_others(spark, sf_dir):
    part, spec = table(spark, sf_dir, "part"), QuerySpec("p_brand", "p_retailprice", limit=5, group_others=True)
    result = aggregate.run_query(part, spec)
    return drill.drill_from_point(part, spec, result, "Others").select("p_partkey", "p_brand")


# Profiles


@query("""SELECT 'c_custkey' AS name, 'identifier' AS semantic_type, 'identifier' AS format, count(DISTINCT c_custkey) AS unique_count FROM customer
UNION ALL SELECT 'c_name', 'identifier', 'general', count(DISTINCT c_name) FROM customer
UNION ALL SELECT 'c_nationkey', 'identifier', 'identifier', count(DISTINCT c_nationkey) FROM customer
UNION ALL SELECT 'c_acctbal', CASE WHEN count(DISTINCT c_acctbal) >= 20 THEN 'metric' ELSE 'categorical' END, 'number', count(DISTINCT c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) < 50 THEN 'categorical' ELSE 'identifier' END, 'general', count(DISTINCT c_mktsegment) FROM customer""")
def column_profile(spark, sf_dir):
    return profile.column_profile(table(spark, sf_dir, "customer"), exact=True).select("name", "semantic_type", "format", "unique_count")


@query("""SELECT 'p_brand' AS name, string_agg(v, '|' ORDER BY lower(v), v) AS sample FROM (SELECT DISTINCT p_brand AS v FROM part ORDER BY lower(v), v LIMIT 20)
UNION ALL SELECT 'p_type', string_agg(v, '|' ORDER BY lower(v), v) FROM (SELECT DISTINCT p_type AS v FROM part ORDER BY lower(v), v LIMIT 20)
UNION ALL SELECT 'p_size', string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS v FROM part ORDER BY v LIMIT 20)""")
def column_samples(spark, sf_dir):
    found = profile.column_profile(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_size"), exact=False)
    return found.select("name", F.array_join("sample_values", "|").alias("sample"))


@query("""SELECT 'o_totalprice' AS name, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS average, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders""")
def metric_summary(spark, sf_dir):
    return rounded(profile.metric_summary(table(spark, sf_dir, "orders"), ["o_totalprice"]))


@query("""SELECT 'o_orderdate' AS "column", strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS "end" FROM orders""")
def time_range(spark, sf_dir):
    return profile.time_range(table(spark, sf_dir, "orders"), "o_orderdate")


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY lower(p_brand), p_brand LIMIT 20")
def facets(spark, sf_dir):
    return profile.facets(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT strftime(o_orderdate, '%Y') AS o_orderdate_year, round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1")
def default_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    spec = profile.default_spec(profile.column_profile(orders, exact=False))
    return rounded(aggregate.run_query(orders, spec).df)


@query("SELECT 'o_orderstatus' AS name, count(DISTINCT o_orderstatus) AS unique_count FROM orders")
def filter_candidates(spark, sf_dir):
    found = profile.column_profile(table(spark, sf_dir, "orders"), exact=True)
    return profile.filter_candidates(found, plotted=("o_orderpriority",)).select("name", "unique_count")


# Missing values


def _gaps(spark, sf_dir) -> DataFrame:
    """lineitem with missing values by rule."""
    key = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").withColumns({"l_tax": F.when(key % 7 != 0, F.col("l_tax")), "l_discount": F.when(key % 5 != 0, F.col("l_discount")), "l_quantity": F.when(key % 11 != 0, F.col("l_quantity"))})


@query("""SELECT 'l_tax' AS "column", count(*) AS missing FROM lineitem WHERE l_orderkey % 7 = 0
UNION ALL SELECT 'l_discount', count(*) FROM lineitem WHERE l_orderkey % 5 = 0
UNION ALL SELECT 'l_quantity', count(*) FROM lineitem WHERE l_orderkey % 11 = 0""")
def missing_report(spark, sf_dir):
    return clean.missing_report(clean.missing_counts(_gaps(spark, sf_dir)), "L_")


@query("""SELECT round(100 - sum((l_orderkey % 7 = 0)::INT + (l_orderkey % 5 = 0)::INT + (l_orderkey % 11 = 0)::INT) / (count(*) * 11.0) * 100, 1) AS quality FROM lineitem""")
def quality_score(spark, sf_dir):
    return spark.createDataFrame([(clean.quality(_gaps(spark, sf_dir)),)], "quality double")


# Type repair


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem")
def repair_numeric_text(spark, sf_dir):
    text = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("l_linenumber"), F.format_number("l_quantity", 1).alias("l_quantity"))
    return clean.repair_types(text)[0]


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def repair_currency(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("$ "), F.format_number("o_totalprice", 2)).alias("o_totalprice"))
    return rounded(clean.repair_types(text)[0])


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(round(l_discount * 100) / 100, 4) AS l_discount FROM lineitem")
def repair_percent(spark, sf_dir):
    percent = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    text = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), percent.alias("l_discount"))
    return rounded(clean.repair_types(text)[0], 4)


def _as_day(df: DataFrame) -> DataFrame:
    """A repaired time as text, as long as it is one."""
    return df.select("o_orderkey", F.date_format("ordered", "yyyy-MM-dd HH:mm:ss").alias("ordered"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS ordered FROM orders")
def repair_dates_us(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("ordered"))
    return _as_day(clean.repair_types(text)[0])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS ordered FROM orders")
def repair_dates_text_month(spark, sf_dir):
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "MMM d, yyyy").alias("ordered"))
    return _as_day(clean.repair_types(text)[0])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS ordered FROM orders")
def repair_dates_with_gaps(spark, sf_dir):
    text = F.when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "yyyy/M/d H:m:s"))
    return _as_day(clean.repair_types(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("ordered")))[0])


# Imputation


def _filled(df: DataFrame, hints: dict[str, str] | None = None) -> DataFrame:
    return clean.impute(df, hints).df


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
coalesce(CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END, (SELECT round(avg(l_quantity), 4) FROM lineitem WHERE l_orderkey % 11 <> 0)) AS l_quantity FROM lineitem""")
def impute_mean(spark, sf_dir):
    rows = _gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(_filled(rows, {"l_quantity": "metric"}), 4)


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 7 <> 0 THEN value END, (SELECT round(median(value), 4) FROM events WHERE event_id % 7 <> 0)) AS value FROM events""")
def impute_median_skewed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    return _filled(rows, {"value": "metric"})


@query("""WITH t AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CASE WHEN event_id % 50 = 0 THEN 'Infinity'::DOUBLE ELSE value END END AS up,
CASE WHEN event_id % 7 <> 0 THEN CASE event_id % 50 WHEN 0 THEN 'Infinity'::DOUBLE WHEN 1 THEN '-Infinity'::DOUBLE ELSE value END END AS ends FROM events)
SELECT event_id, coalesce(up, 'Infinity'::DOUBLE) AS up, ends, (SELECT round(median(ends), 4) FROM t) AS middle FROM t""")
def impute_infinite(spark, sf_dir):
    key, inf = F.col("event_id"), F.lit(float("inf"))
    up = F.when(key % 50 == 0, inf).otherwise(F.col("value"))
    ends = F.when(key % 50 == 1, -inf).otherwise(up)
    rows = table(spark, sf_dir, "events").select("event_id", F.when(key % 7 != 0, up).alias("up"), F.when(key % 7 != 0, ends).alias("ends"))
    done = clean.impute(rows, {"up": "metric", "ends": "metric"})
    middle = stats.median(rows, "ends", done.rows - done.missing.get("ends", 0))
    return done.df.withColumn("middle", F.lit(None if middle is None else stats.round_half_away(middle)).cast("double"))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END,
(SELECT l_tax FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1 ORDER BY count(*) DESC, l_tax LIMIT 1)) AS l_tax FROM lineitem""")
def impute_mode(spark, sf_dir):
    return rounded(_filled(_gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_tax")), 4)


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, coalesce(CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 13 = 0 THEN l_discount ELSE 0.0 END, 0.0) AS bonus
FROM lineitem""")
def impute_zero(spark, sf_dir):
    key = F.col("l_orderkey")
    bonus = F.when(key % 7 == 0, None).when(key % 13 == 0, F.col("l_discount")).otherwise(0.0)
    return rounded(_filled(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", bonus.alias("bonus"))), 4)


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 5 END, -1) AS status_code FROM orders")
def impute_sentinel(spark, sf_dir):
    code = F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 5)
    return _filled(table(spark, sf_dir, "orders").select("o_orderkey", code.alias("status_code")))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN l_orderkey % 11 <> 0 THEN l_quantity END AS l_quantity FROM lineitem""")
def impute_leave_null(spark, sf_dir):
    return rounded(_filled(_gaps(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_quantity")))


@query("""SELECT l_orderkey, coalesce(CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END, (SELECT round(avg(l_tax), 2) FROM lineitem WHERE l_orderkey % 7 <> 0)) AS l_tax,
coalesce(CASE WHEN l_orderkey % 3 <> 0 THEN l_returnflag END, (SELECT l_returnflag FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag
FROM lineitem""")
def simple_impute(spark, sf_dir):
    flag = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_returnflag"))
    return clean.simple_impute(_gaps(spark, sf_dir).select("l_orderkey", "l_tax", flag.alias("l_returnflag")))


# Whole ingestion


@query("""SELECT o_orderkey, round(o_totalprice, 2) AS total_price, strftime(o_orderdate, '%Y-%m-%d') AS ordered,
coalesce(CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 5 END, -1) AS status_code,
CASE WHEN o_orderkey % 3 = 0 THEN 'say ""' || o_orderpriority || '"", ok' WHEN o_orderkey % 3 = 1 THEN 'two' || chr(10) || 'lines, "' ELSE o_orderstatus || ' ' END AS note FROM orders""")
def csv_ingest(spark, sf_dir):
    code = F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_custkey") % 5).cast("string")).otherwise("N/A")
    price, day = F.concat(F.lit("$"), F.format_number("o_totalprice", 2)), F.date_format("o_orderdate", "yyyy/M/d")
    third = F.col("o_orderkey") % 3
    note = F.when(third == 0, F.concat(F.lit('say ""'), "o_orderpriority", F.lit('"", ok'))).when(third == 1, F.lit('two\nlines, "')).otherwise(F.concat("o_orderstatus", F.lit(" ")))
    path = tables.scratch(spark, "orders.csv")
    dirty = table(spark, sf_dir, "orders").select("o_orderkey", price, day, code, note).toDF("O_OrderKey", " Total Price ", "Ordered", "Status Code", "note")
    dirty.write.csv(path, header=True, quote='"', escape='"', ignoreTrailingWhiteSpace=False)
    done = tables.ingest(spark, path).df
    return done.select("o_orderkey", F.round("total_price", 2).alias("total_price"), F.date_format("ordered", "yyyy-MM-dd").alias("ordered"), F.col("status_code").cast("long").alias("status_code"), "note")


@query("""SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus || chr(10) || 'next, line' ELSE o_orderstatus END AS status,
CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS customer,
CASE WHEN o_orderkey % 10 = 5 THEN o_orderkey || ',' || CASE WHEN o_orderkey % 4 = 1 THEN '"' || o_orderstatus || chr(10) || 'next, line"' ELSE o_orderstatus END || ',' || o_custkey || ',,more' END AS extra_fields,
'Kept ' || (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 5) || ' rows with more fields than the header' AS log FROM orders""")
def csv_extra_fields(spark, sf_dir):
    key, path = F.col("o_orderkey"), tables.scratch(spark, "extra.csv")
    status = F.when(key % 4 == 1, F.concat(F.lit('"'), "o_orderstatus", F.lit('\nnext, line"'))).otherwise(F.col("o_orderstatus"))
    rest = F.when(key % 10 == 5, F.concat(F.lit(","), "o_custkey", F.lit(",,more"))).when(key % 10 == 3, "").otherwise(F.concat(F.lit(","), "o_custkey"))
    records = table(spark, sf_dir, "orders").select(F.concat(key.cast("string"), F.lit(","), status, rest).alias("value"))
    # a folder of files, each with a header of its own
    headed = records.mapInArrow(_with_header, "value string")
    headed.write.text(path)
    done = tables.ingest(spark, path, extra="keep")
    return done.df.select("order_key", "status", F.col("customer").cast("long").alias("customer"), "extra_fields").withColumn("log", F.lit(done.actions[0][1]))


def _with_header(batches):
    for i, batch in enumerate(batches):
        yield from [pa.RecordBatch.from_pydict({"value": ["Order Key,Status,Customer"]})] * (i == 0)
        yield batch


@query("""SELECT CAST(0 AS BIGINT) AS seq, NULL AS "column", 'Normalized 1 column headers' AS action, CAST(1 AS BIGINT) AS affected
UNION ALL SELECT 1, 'price', 'Converted price from currency text to numbers', count(*) FROM orders
UNION ALL SELECT 2, 'share', 'Converted share from percent text to fractions', count(*) FILTER (WHERE o_orderkey % 9 <> 0) FROM orders
UNION ALL SELECT 3, 'share', 'Filled ' || count(*) FILTER (WHERE o_orderkey % 9 = 0) || ' missing share values with the mode (bounded)', count(*) FILTER (WHERE o_orderkey % 9 = 0) FROM orders""")
def cleaning_log(spark, sf_dir):
    share = F.when(F.col("o_orderkey") % 9 != 0, F.concat((F.col("o_custkey") % 100).cast("string"), F.lit("%")))
    text = table(spark, sf_dir, "orders").select(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"), share.alias("Share"))
    return rounded(clean.clean(text).cleaning_log())


@query("""WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 4),
r AS (SELECT CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE 'Others' END AS p_brand, round(sum(p_retailprice), 2) AS p_retailprice FROM part GROUP BY 1)
SELECT row_number() OVER (ORDER BY p_brand = 'Others', p_brand) AS place, * FROM r""")
def others_last(spark, sf_dir):
    result = aggregate.run_query(table(spark, sf_dir, "part"), QuerySpec("p_brand", "p_retailprice", limit=5, group_others=True))
    rows = [(i, *r) for i, r in enumerate(rounded(aggregate.others_last(result)).collect(), 1)]
    return spark.createDataFrame(rows, "place long, p_brand string, p_retailprice double")


# Headers, reports, display, statistics


@query("SELECT o_orderkey AS order_key, o_totalprice AS total_price, o_custkey AS a, o_orderstatus AS a_3, o_orderpriority AS a_2 FROM orders")
def normalize_headers(spark, sf_dir):
    dirty = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority").toDF("  Order Key! ", "Total  Price ($)", "A", "a", "a_2")
    return clean.normalize_headers(dirty)[0]


@query("""SELECT 'by_priority' AS widget, 'o_totalprice' AS metric, o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 3
UNION ALL SELECT 'by_status', 'o_totalprice', o_orderstatus, round(avg(o_totalprice), 2) FROM orders GROUP BY 3
UNION ALL SELECT 'by_year', 'o_orderkey', strftime(o_orderdate, '%Y'), CAST(count(o_orderkey) AS DOUBLE) FROM orders GROUP BY 3""")
def report_long(spark, sf_dir):
    specs = {"by_priority": QuerySpec("o_orderpriority", "o_totalprice"), "by_status": QuerySpec("o_orderstatus", "o_totalprice", "mean"), "by_year": QuerySpec("o_orderdate", "o_orderkey", "count")}
    return rounded(report.build_report(table(spark, sf_dir, "orders"), specs))


@query("""WITH f AS (SELECT * FROM lineitem WHERE l_quantity >= 10)
SELECT 'flag' AS widget, 'l_tax' AS metric, l_returnflag AS label, round(sum(l_tax), 2) AS value FROM f GROUP BY 3
UNION ALL SELECT 'flag', 'l_quantity', l_returnflag, round(sum(l_quantity), 2) FROM f GROUP BY 3
UNION ALL SELECT 'line', 'l_tax', CAST(l_linenumber AS VARCHAR), max(l_tax) FROM f GROUP BY 3
UNION ALL SELECT 'month', 'l_quantity', strftime(l_shipdate, '%Y'), round(avg(l_quantity), 2) FROM f GROUP BY 3
UNION ALL SELECT 'all', 'l_quantity', l_linestatus, round(avg(l_quantity), 2) FROM lineitem GROUP BY 3
UNION ALL SELECT 'middle', 'l_quantity', l_linestatus, median(l_quantity) FROM lineitem GROUP BY 3""")
def report_of_filtered_rows(spark, sf_dir):
    some = (Filter("l_quantity", "gte", 10),)
    specs = {
        "flag": QuerySpec("l_returnflag", ("l_tax", "l_quantity"), filters=some), "line": QuerySpec("l_linenumber", "l_tax", "max", filters=some), "month": QuerySpec("l_shipdate", "l_quantity", "mean", filters=some),
        "all": QuerySpec("l_linestatus", "l_quantity", "mean"), "middle": QuerySpec("l_linestatus", "l_quantity", "median"),
    }
    return rounded(report.build_report(table(spark, sf_dir, "lineitem"), specs))


@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
CASE WHEN l_extendedprice >= 1e6 THEN format('${:.1f}M', l_extendedprice / 1e6) WHEN l_extendedprice >= 1e3 THEN format('${:.1f}K', l_extendedprice / 1e3) ELSE format('${:.0f}', l_extendedprice) END AS price,
format('{:.1f}%', l_discount * 100) AS discount FROM lineitem""")
def display_values(spark, sf_dir):
    price, discount = display_value(F.col("l_extendedprice"), "currency", compact=True), display_value(F.col("l_discount"), "percentage")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), price.alias("price"), discount.alias("discount"))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS stddev_l_quantity, round(stddev_samp(l_extendedprice), 6) AS stddev_l_extendedprice,
round(corr(l_quantity, l_extendedprice), 6) AS corr_l_quantity_l_extendedprice FROM lineitem GROUP BY 1""")
def summary_stats(spark, sf_dir):
    return rounded(aggregate.summary_stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag"), 6)


# Requests: checks, merging, limits, notes


def _told(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A few facts about results, each with what was counted over the table."""
    return spark.createDataFrame(rows, schema)


def _refusal(work: Callable[[], object]) -> str:
    try:
        work()
    except (ValueError, KeyError) as e:
        return type(e).__name__
    return "none"


@query("""SELECT event_id FROM events WHERE event_id % 7 <> 0 AND value < 20
UNION ALL SELECT -event_id FROM events WHERE event_id % 7 <> 0 AND value >= 20""")
def filter_null_never_matches(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    low, high = (apply_filters(events, [Filter("value", how, 20)])[0] for how in ("lt", "gte"))
    return low.select("event_id").union(high.select(-F.col("event_id")))


@query("""SELECT 'no such column: nowhere: skipped' AS note, count(*) AS n FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'o_totalprice gt ''much'' was skipped: not a number', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'o_custkey lt has no value: skipped', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'no such operator: like: skipped', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'o_orderdate gt ''never'' was skipped: not a time', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'o_orderstatus eq F', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'strict: ValueError', count(*) FROM orders""")
def filter_notes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    wanted = [Filter("nowhere", "eq", 1), Filter("o_totalprice", "gt", "much"), Filter("o_custkey", "lt", None), Filter("o_custkey", "like", 3), Filter("o_orderdate", "gt", "never"), Filter("o_orderstatus", "eq", "F")]
    rows, notes = apply_filters(orders, wanted)
    n = rows.count()
    strict = _refusal(lambda: apply_filters(orders, wanted, strict=True))
    return _told(spark, [*[(note, n) for note in notes], (f"strict: {strict}", orders.count())], "note string, n long")


@query("""SELECT o_orderpriority, count(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000 AND o_custkey <= 500 GROUP BY 1""")
def filters_replaced_and_merged(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    spec = QuerySpec("o_orderpriority", "o_orderkey", "count", filters=(Filter("o_orderstatus", "eq", "F"), Filter("o_custkey", "lte", 500)))
    spec = spec.with_filter(Filter("o_orderstatus", "eq", "O"))
    extra = [{"column": "o_totalprice", "operator": "gte", "value": 100000}, {"column": "o_custkey", "operator": "eq", "value": [1, 2]}, {"operator": "eq", "value": 3}, {"column": "o_custkey", "how": "eq"}]
    return rounded(aggregate.run_query(orders, spec.merge(extra, orders)).df)


@query("""SELECT 'aggregate' AS request, 'ValueError' AS refused, count(*) AS n FROM orders UNION ALL SELECT 'x', 'ValueError', count(*) FROM orders
UNION ALL SELECT 'y', 'ValueError', count(*) FROM orders UNION ALL SELECT 'limit', 'ValueError', count(*) FROM orders
UNION ALL SELECT 'sum of text', 'ValueError', count(*) FROM orders UNION ALL SELECT 'merged column', 'ValueError', count(*) FROM orders
UNION ALL SELECT 'merged operator', 'ValueError', count(*) FROM orders UNION ALL SELECT 'dataset', 'KeyError', count(*) FROM orders UNION ALL SELECT 'good', 'none', count(*) FROM orders""")
def requests_refused(spark, sf_dir):
    orders, good = table(spark, sf_dir, "orders"), QuerySpec("o_orderstatus", "o_totalprice")
    bad = {
        "aggregate": lambda: QuerySpec("o_orderstatus", "o_totalprice", "product"),
        "x": lambda: aggregate.run_query(orders, QuerySpec("nowhere", "o_totalprice")),
        "y": lambda: aggregate.run_query(orders, QuerySpec("o_orderstatus", "nowhere")),
        "limit": lambda: aggregate.run_query(orders, QuerySpec("o_orderstatus", "o_totalprice", limit=-1)),
        "sum of text": lambda: aggregate.run_query(orders, QuerySpec("o_orderstatus", "o_orderpriority")),
        "merged column": lambda: good.merge([{"column": "nowhere", "operator": "eq", "value": 1}], orders),
        "merged operator": lambda: good.merge([{"column": "o_custkey", "operator": "like", "value": 1}], orders),
        "dataset": lambda: tables.dataset(spark, "no_such_table"),
        "good": lambda: aggregate.run_query(orders, good),
    }
    n = orders.count()
    return _told(spark, [(name, _refusal(work), n) for name, work in bad.items()], "request string, refused string, n long")


@query("""WITH d AS (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)
SELECT 'all' AS wanted, least(n, 500) AS n, n > 500 AS capped, true AS warned FROM d UNION ALL SELECT 'too many', least(n, 500), n > 500, true FROM d
UNION ALL SELECT 'three', least(n, 3), n > 3, false FROM d UNION ALL SELECT 'default', least(n, 50), n > 50, false FROM d""")
def limits_and_warnings(spark, sf_dir):
    lines, out = table(spark, sf_dir, "lineitem"), []
    for name, limit in (("all", 0), ("too many", 501), ("three", 3), ("default", None)):
        result = aggregate.run_query(lines, QuerySpec("l_partkey", "l_quantity", limit=limit))
        out.append((name, result.df.count(), result.capped(), any("at most" in x for x in result.notes)))
    return _told(spark, out, "wanted string, n long, capped boolean, warned boolean")


@query("""SELECT count(*) FILTER (WHERE o_totalprice < 0) AS n, 'no rows match the filters; relax them or widen their ranges' AS note, count(*) AS n_all, NULL AS note_all FROM orders""")
def empty_result_note(spark, sf_dir):
    orders, spec = table(spark, sf_dir, "orders"), QuerySpec("o_orderstatus", "o_totalprice", "count")
    none, every = (aggregate.run_query(orders, QuerySpec("o_orderstatus", "o_totalprice", "count", filters=(Filter("o_totalprice", "lt", 0),))), aggregate.run_query(orders, spec))
    row = (none.df.agg(F.coalesce(F.sum("o_totalprice"), F.lit(0))).first()[0], none.empty_note(), every.df.agg(F.sum("o_totalprice")).first()[0], every.empty_note())
    return _told(spark, [row], "n long, note string, n_all long, note_all string")


@query("""WITH t AS (SELECT event_id, TIMESTAMP '2024-03-01 10:00:00' + INTERVAL 1 MILLISECOND * ((event_id % 40) * 250) AS ts FROM events),
l AS (SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM t) SELECT event_id, ts FROM l WHERE ts IN ('2024-03-01 10:00:00', '2024-03-01 10:00:07')""")
def drill_from_a_second(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    moment = F.expr("timestamp_ntz'2024-03-01 10:00:00' + make_dt_interval(0, 0, 0, (event_id % 40) * 0.25)")
    times, spec = events.select("event_id", moment.alias("ts")), QuerySpec("ts", "event_id", "count")
    result = aggregate.run_query(times, spec)
    found = [drill.drill_from_point(times, spec, result, label).select("event_id", F.lit(label).alias("ts")) for label in ("2024-03-01 10:00:00", "2024-03-01 10:00:07")]
    return found[0].union(found[1])


# Datasets and cleaning that leaves things alone


@query("""SELECT 'preview' AS what, least(count(*), 100) AS n, count(*) AS total FROM orders UNION ALL SELECT 'registered', count(*), count(*) FROM orders
UNION ALL SELECT 'ValueError', 0, count(*) FROM orders UNION ALL SELECT 'ValueError', 1, count(*) FROM orders""")
def datasets(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    tables.register(orders, "slatework_orders")
    rows, total = tables.preview(tables.dataset(spark, "slatework_orders"))
    n, empty = total.first()["total"], tables.scratch(spark, "empty.csv")
    orders.limit(0).coalesce(1).write.csv(empty, header=True)
    out = [("preview", rows.count(), n), ("registered", tables.dataset(spark, "slatework_orders").count(), n)]
    out += [(_refusal(lambda path=path: tables.read_csv(spark, path)), i, n) for i, path in enumerate((empty, f"{sf_dir}/orders.parquet"))]
    return _told(spark, out, "what string, n long, total long")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 4 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderpriority END AS mixed,
CASE WHEN o_orderkey % 10 < 6 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'soon' END AS some_dates,
CASE WHEN o_orderkey % 10 < 6 THEN CAST(o_custkey AS DOUBLE) / 2 END AS number_first FROM orders""")
def repair_leaves_text_and_keeps_precedence(spark, sf_dir):
    tenth = F.col("o_orderkey") % 10
    text = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(tenth < 4, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderpriority")).alias("mixed"),
        F.when(tenth < 6, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise("soon").alias("some_dates"),
        F.when(tenth < 6, F.format_number(F.col("o_custkey") / 2, 1)).otherwise(F.concat((F.col("o_custkey") % 90).cast("string"), F.lit("%"))).alias("number_first"),
    )
    return clean.repair_types(text)[0]


@query("""SELECT o_orderkey, CAST(NULL AS DOUBLE) AS nothing, 'Left ' || count(*) OVER () || ' missing nothing values null (low-confidence imputation)' AS log FROM orders""")
def impute_nothing(spark, sf_dir):
    done = clean.impute(table(spark, sf_dir, "orders").select("o_orderkey", F.lit(None).cast("double").alias("nothing")), {"nothing": "metric"})
    return done.df.withColumn("log", F.lit(done.actions[0][1]))


# Whole profiles, shapes, display


@query("""SELECT 'rows' AS fact, '' AS name, CAST(count(*) AS VARCHAR) AS value FROM orders UNION ALL SELECT 'columns', '', '6' FROM orders GROUP BY ALL HAVING count(*) > 0
UNION ALL SELECT 'total', 'o_totalprice', format('{:.2f}', sum(o_totalprice)) FROM orders UNION ALL SELECT 'start', 'o_orderdate', strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders
UNION ALL SELECT 'end', 'o_orderdate', strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders""")
def whole_profile(spark, sf_dir):
    found = profile.profile(table(spark, sf_dir, "orders"))
    facts = spark.createDataFrame([("rows", "", str(found["rows"])), ("columns", "", str(found["columns"]))], "fact string, name string, value string")
    totals = found["metrics"].filter("name = 'o_totalprice'").select(F.lit("total").alias("fact"), "name", F.format_string("%.2f", "total").alias("value"))
    times = [found["time_range"].select(F.lit(end).alias("fact"), F.col("column").alias("name"), F.col(end).alias("value")) for end in ("start", "end")]
    return facts.union(totals).union(times[0]).union(times[1])


@query("""WITH p AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 13 <> 0 THEN p_retailprice END AS price, p_size FROM part WHERE p_partkey % 4 <> 3)
SELECT 'p_brand' AS name, 'categorical' AS semantic_type, count(DISTINCT p_brand) AS unique_count, 0 AS missing, NULL AS low, (SELECT string_agg(v, '|' ORDER BY lower(v), v) FROM (SELECT DISTINCT p_brand AS v FROM p ORDER BY lower(v), v LIMIT 20)) AS sample FROM p
UNION ALL SELECT 'price', 'metric', NULL, count(*) - count(price), min(price), NULL FROM p
UNION ALL SELECT 'p_size', CASE WHEN count(DISTINCT p_size) >= 20 THEN 'metric' ELSE 'categorical' END, count(DISTINCT p_size), 0, min(p_size), (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS v FROM p ORDER BY v LIMIT 20)) FROM p""")
def statistics_after_append(spark, sf_dir):
    part, path, kept = table(spark, sf_dir, "part"), tables.scratch(spark, "part"), tables.scratch(spark, "statistics")
    part = part.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 13 != 0, F.col("p_retailprice")).alias("price"), "p_size")
    for k in range(3):
        part.filter(F.col("p_partkey") % 4 == k).drop("p_partkey").write.mode("append").parquet(path)
        found, _ = statistics.refresh(spark, path, kept)
    seen = statistics.profile(found, spark.read.parquet(path)).join(statistics.merged(found).withColumnRenamed("column", "name"), "name")
    few = F.col("name") != "price"
    return seen.select("name", "semantic_type", F.when(few, F.col("unique_count")).alias("unique_count"), "missing", "low", F.when(few, F.array_join("sample_values", "|")).alias("sample"))


@query("""WITH s AS (SELECT * FROM customer WHERE c_custkey % 3 = 1)
SELECT 'customer_key' AS name, 'Customer Key' AS title, 'identifier' AS semantic_type, count(DISTINCT c_custkey) AS unique_count, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS v FROM s ORDER BY v LIMIT 20)) AS sample FROM s
UNION ALL SELECT 'market_segment', 'Market Segment', 'categorical', count(DISTINCT c_mktsegment), (SELECT string_agg(v, '|' ORDER BY lower(v), v) FROM (SELECT DISTINCT c_mktsegment AS v FROM s ORDER BY lower(v), v LIMIT 20)) FROM s""")
def sampled_profile(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").selectExpr("c_custkey AS customer_key", "c_mktsegment AS market_segment")
    found = profile.column_profile(customers, exact=True, where=F.col("customer_key") % 3 == 1)
    return found.select("name", title(F.col("name")).alias("title"), "semantic_type", "unique_count", F.array_join("sample_values", "|").alias("sample"))


@query("""WITH t AS (SELECT o_orderpriority AS p, round(sum(o_totalprice), 2) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT 'table' AS shape, p AS x, format('{:.2f}', v) AS y FROM t UNION ALL SELECT 'mapping', p, format('{:.2f}', v) FROM t UNION ALL SELECT 'scalar', 'result', CAST(count(*) AS VARCHAR) FROM t""")
def chart_shapes(spark, sf_dir):
    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))

    found = report.transform(table(spark, sf_dir, "orders"), sums, (Filter("o_orderstatus", "eq", "F"),))
    pairs = {r["o_orderpriority"]: r["v"] for r in found.collect()}
    shapes = {"table": report.to_chart_shape(found), "mapping": report.to_chart_shape(pairs, spark), "scalar": report.to_chart_shape(len(pairs), spark)}
    parts = [shape.df.select(F.lit(name).alias("shape"), F.col(shape.x).alias("x"), F.format_string("%.2f" if name != "scalar" else "%s", F.col(shape.ys[0])).alias("y")) for name, shape in shapes.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), f AS (SELECT k, n FROM t ORDER BY k LIMIT 300)
SELECT 'table' AS shape, CAST(k AS VARCHAR) AS x, CAST(n AS DOUBLE) AS y FROM (SELECT * FROM f ORDER BY k LIMIT 100) UNION ALL SELECT 'mapping', CAST(k AS VARCHAR), CAST(n AS DOUBLE) FROM (SELECT * FROM f ORDER BY k LIMIT 50)""")
def chart_shapes_are_capped(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy("o_custkey").limit(300)
    pairs = {r["o_custkey"]: r["n"] for r in counts.collect()}
    shapes = {"table": report.to_chart_shape(counts), "mapping": report.to_chart_shape(pairs, spark)}
    parts = [s.df.select(F.lit(name).alias("shape"), F.col(s.x).cast("string").alias("x"), F.col(s.ys[0]).cast("double").alias("y")) for name, s in shapes.items()]
    return parts[0].union(parts[1])


@query("""SELECT o_orderkey, CASE WHEN o_totalprice * 1e5 >= 1e9 THEN format('{:.1f}B', o_totalprice * 1e5 / 1e9) ELSE format('{:.1f}M', o_totalprice * 1e5 / 1e6) END AS shown FROM orders
WHERE o_totalprice >= 1000""")
def display_billions(spark, sf_dir):
    big = apply_filters(table(spark, sf_dir, "orders"), [Filter("o_totalprice", "gte", 1000)])[0]
    return big.select("o_orderkey", display_value(F.col("o_totalprice") * 1e5, compact=True).alias("shown"))
