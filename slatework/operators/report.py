"""Saved sets of results, and results in one shape."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.operators.aggregate import answered, asked
from slatework.operators.filters import apply_filters
from slatework.operators.scratch import stored
from slatework.operators.stats import TIMES
from slatework.plans.spec import DEFAULT_ROWS, Filter, QueryResult, QuerySpec


def shared_groups(rows: DataFrame, specs: Mapping[str, QuerySpec]) -> dict[str, DataFrame]:
    """Mergeable aggregates for several requests over the same rows, from one scan: every row counts once
    for each request, under that request's x (or its day), in one partial aggregate."""
    kinds = {w: isinstance(rows.schema[s.x].dataType, TIMES) for w, s in specs.items()}
    none = F.lit(None)
    keys = []
    for w, s in specs.items():
        x = F.col(f"`{s.x}`")
        text, moment = (none, x) if kinds[w] else (x, none)
        keys.append(F.struct(F.lit(w).alias("_w"), text.cast("string").alias("_x"), moment.cast("timestamp").alias("_t")))
    used = sorted({y for s in specs.values() for y in s.ys})
    place = {y: f"_y{i}" for i, y in enumerate(used)}
    every = rows.select(*[F.col(f"`{y}`").alias(n) for y, n in place.items()], F.inline(F.array(*keys))).withColumn("_day", F.date_trunc("day", "_t"))
    wanted: dict[tuple[str, str], Column] = {}
    for s in specs.values():
        for y in s.ys:
            for how in ("sum", "count") if s.aggregation in ("sum", "mean") else (s.aggregation,):
                mine = F.col("_w").isin(*[w for w, o in specs.items() if y in o.ys])
                wanted[how, y] = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}[how](F.when(mine, F.col(place[y]))).alias(f"{how}{place[y]}")
    facts = [F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.bool_and(F.col("_t") == F.col("_day")).alias("_whole"), F.approx_count_distinct("_t", 0.05).alias("_about")]
    groups = stored(every.groupBy("_w", "_x", "_day").agg(*wanted.values(), *facts), "groups")
    out = {}
    for w, s in specs.items():
        parts = []
        for i, y in enumerate(dict.fromkeys(s.ys)):
            first = "sum" if s.aggregation in ("sum", "mean") else s.aggregation
            parts += [F.col(f"{first}{place[y]}").alias(f"_a{i}"), *([F.col(f"count{place[y]}").alias(f"_b{i}")] if first == "sum" else [])]
        mine = groups.filter((F.col("_w") == w) & F.col("_day" if kinds[w] else "_x").isNotNull())
        key = ["_day", "_low", "_high", "_whole", "_about"] if kinds[w] else [F.col("_x").cast(rows.schema[s.x].dataType).alias("_x")]
        out[w] = mine.select(*key, *parts)
    return out


def build_report(df: DataFrame, specs: Mapping[str, QuerySpec], semantic_types: Mapping[str, str] | None = None) -> DataFrame:
    """(widget, metric, label, value): the results of several requests, long.

    Requests with the same filters share one scan of their rows, unless they take medians or a bucket of
    Others, which scan for themselves."""
    types = dict(semantic_types or {})
    ready = {w: asked(df, s, types, False, DEFAULT_ROWS) for w, s in specs.items()}
    together: dict[str, list[str]] = {}
    for w, (spec, *_) in ready.items():
        plain = not isinstance(df.schema[spec.x].dataType, (T.FloatType, T.DoubleType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))
        if spec.aggregation != "median" and not spec.group_others and plain:
            together.setdefault(repr(spec.filters), []).append(w)
    groups: dict[str, DataFrame] = {}
    for widgets in together.values():
        if len(widgets) > 1:
            groups |= shared_groups(ready[widgets[0]][1], {w: ready[w][0] for w in widgets})
    parts = []
    for widget, (spec, rows, limit, notes) in ready.items():
        result = answered(rows, spec, limit, notes, types, groups.get(widget))
        values = [F.col(f"`{y}`").cast("double").alias(y) for y in result.ys]
        wide = result.df.select(F.col(f"`{result.x}`").alias("label"), *values)
        long = wide.unpivot(["label"], list(result.ys), "metric", "value")
        parts.append(long.select(F.lit(widget).alias("widget"), "metric", "label", "value"))
    return functools.reduce(DataFrame.unionByName, parts)


def write_report(report: DataFrame, path: str) -> None:
    """The report as Parquet, a folder per widget."""
    report.write.mode("overwrite").partitionBy("widget").parquet(path)


def transform(df: DataFrame, fn: Callable[[DataFrame], DataFrame], filters: tuple[Filter, ...] = ()) -> DataFrame:
    """A user's own DataFrame function over the filtered rows."""
    return apply_filters(df, filters)[0].transform(fn)


def to_chart_shape(found: Any, spark: SparkSession | None = None, rows: int = 100) -> QueryResult:
    """Any result as a QueryResult: of a DataFrame the first column is x and the rest are ys, at most
    ``rows`` rows; a mapping is category and value, at most half as many; a scalar is one value."""
    if isinstance(found, DataFrame):
        x, *ys = found.columns
        return QueryResult(found.limit(rows), x, tuple(ys), limit=rows)
    spark = spark or SparkSession.getActiveSession()
    if isinstance(found, Mapping):
        pairs = [(str(k), float(v)) for k, v in list(found.items())[: rows // 2]]
        return QueryResult(spark.createDataFrame(pairs, "category string, value double"), "category", ("value",))
    return QueryResult(spark.createDataFrame([("result", str(found))], "category string, value string"), "category", ("value",))
