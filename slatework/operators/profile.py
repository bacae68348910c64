"""What columns mean, profiles, facets, and the request a table suggests."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.operators.clean import column_formats, has
from slatework.operators.stats import TIMES, col, distinct_counts, exact_distinct, first_values, is_number, one_pass
from slatework.plans.spec import QuerySpec

#: Parts of names that tell a column's meaning.
TEMPORAL_NAMES = ("date", "time", "year", "month", "day", "timestamp")
IDENTIFIER_NAMES = ("id", "code", "key", "name", "email", "phone", "address")

PROFILE = "position int, name string, dtype string, is_numeric boolean, is_datetime boolean, semantic_type string, format string, unique_count long, sample_values array<string>"


def semantic_type(name: str, kind: T.DataType, distinct: int, rows: int) -> str:
    """temporal, identifier, metric or categorical."""
    if isinstance(kind, TIMES) or has(name, TEMPORAL_NAMES):
        return "temporal"
    if has(name, IDENTIFIER_NAMES):
        return "identifier"
    if is_number(kind) or isinstance(kind, T.BooleanType):
        return "metric" if distinct > 0.5 * rows or distinct >= 20 else "categorical"
    return "categorical" if distinct < 50 else "identifier"


def facets(df: DataFrame, name: str, limit: int | None = 20) -> DataFrame:
    """(value, n): distinct values as text, in case-insensitive order, and their rows."""
    found = df.filter(col(name).isNotNull()).groupBy(col(name).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    found = found.orderBy(F.lower("value"), "value")
    return found if limit is None else found.limit(limit)


def plain_fields(df: DataFrame) -> list[T.StructField]:
    return [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]


def column_profile(df: DataFrame, hints: Mapping[str, str] | None = None, parsed: Mapping[str, str] | None = None, exact: bool = False, fraction: float | None = None, where: Column | None = None) -> DataFrame:
    """A row per column: type, meaning, format, distinct values and up to 20 of them.

    One pass for counts and ranges, one for the values. ``exact`` distinct counts shuffle them all;
    otherwise they are estimates, exact only near a threshold. ``fraction`` profiles a repeatable
    sample (seed 42) instead of all rows, ``where`` those rows for which it holds. Nested columns are left out."""
    df = df if fraction is None else df.sample(fraction, seed=42)
    df = df if where is None else df.filter(where)
    fields = plain_fields(df)
    wanted = {("", "rows"): F.count(F.lit(1))}
    for f in fields:
        c = col(f.name)
        wanted[f.name, "about"] = F.lit(0) if exact else F.approx_count_distinct(c)
        if is_number(f.dataType):
            wanted |= {(f.name, "min"): F.min(c), (f.name, "max"): F.max(c)}
    seen = one_pass(df, wanted)
    rows = seen["", "rows"]
    names = [f.name for f in fields]
    counts = exact_distinct(df, names) if exact else distinct_counts(df, {c: (20, 50, rows * 0.5) for c in names}, {c: seen[c, "about"] for c in names})
    samples = first_values(df, names)
    ranges = {f.name: (seen[f.name, "min"], seen[f.name, "max"]) for f in fields if is_number(f.dataType)}
    return profile_rows(df, fields, rows, counts, samples, ranges, hints, parsed)


def profile_rows(df: DataFrame, fields: list[T.StructField], rows: int, counts: Mapping[str, int], samples: Mapping[str, list[str]], ranges: Mapping[str, tuple], hints: Mapping[str, str] | None = None, parsed: Mapping[str, str] | None = None) -> DataFrame:
    """A profile's table from what is known of each column."""
    formats = column_formats(df.select(*[col(f.name) for f in fields]), parsed or {}, ranges)
    out = []
    for i, f in enumerate(fields):
        time = isinstance(f.dataType, TIMES)
        meaning = (hints or {}).get(f.name) or semantic_type(f.name, f.dataType, counts[f.name], rows)
        number = is_number(f.dataType) or isinstance(f.dataType, T.BooleanType)
        shown = formats.get(f.name, "date" if time else "general")
        out.append((i, f.name, f.dataType.simpleString(), number, time, meaning, shown, counts[f.name], samples[f.name]))
    return df.sparkSession.createDataFrame(out, PROFILE)


def columns_by_meaning(profile: DataFrame) -> dict[str, list[str]]:
    """Names of columns in order: numeric, categorical, metric, temporal, identifier."""
    rows = profile.orderBy("position").collect()
    out = {m: [r["name"] for r in rows if r["semantic_type"] == m] for m in ("categorical", "metric", "temporal", "identifier")}
    return out | {"numeric": [r["name"] for r in rows if r["is_numeric"]]}


def metric_summary(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(name, total, average, min, max) of the first three metrics that have values; one pass."""
    metrics = metrics[:3]
    parts = [F.struct(F.lit(m).alias("name"), F.sum(col(m)).cast("double").alias("total"), F.avg(col(m)).alias("average"), F.min(col(m)).cast("double").alias("min"), F.max(col(m)).cast("double").alias("max")) for m in metrics]
    return df.agg(F.array(*parts).alias("m")).select(F.inline("m")).filter("total is not null")


def time_range(df: DataFrame, name: str) -> DataFrame:
    """(column, start, end) of a time column with values."""
    return df.agg(F.lit(name).alias("column"), F.min(col(name)).cast("string").alias("start"), F.max(col(name)).cast("string").alias("end")).filter("start is not null")


def profile(df: DataFrame, hints: Mapping[str, str] | None = None) -> dict:
    """Row and column counts, metric summary, and the range of the first time column."""
    groups = columns_by_meaning(column_profile(df, hints, exact=False))
    times = [c for c in groups["temporal"][:1] if isinstance(df.schema[c].dataType, TIMES)]
    metrics = [c for c in groups["metric"] if is_number(df.schema[c].dataType)]
    return {"rows": df.count(), "columns": len(df.columns), "metrics": metric_summary(df, metrics) if metrics else None, "time_range": time_range(df, times[0]) if times else None}


def default_spec(profile: DataFrame) -> QuerySpec | None:
    """The request to start with: the first two metrics by time, else by the category with about 10
    values, else the next metrics by the first; None without metrics."""
    groups = columns_by_meaning(profile)
    metrics = groups["metric"]
    if not metrics:
        return None
    if groups["temporal"]:
        return QuerySpec(groups["temporal"][0], tuple(metrics[:2]))
    if groups["categorical"]:
        counts = {r["name"]: r["unique_count"] for r in profile.collect()}
        return QuerySpec(min(groups["categorical"], key=lambda c: abs(counts[c] - 10)), tuple(metrics[:2]))
    return QuerySpec(metrics[0], tuple(metrics[1:3])) if len(metrics) > 1 else None


def filter_candidates(profile: DataFrame, plotted: tuple[str, ...] = (), limit: int = 2, low: int = 2, high: int = 50) -> DataFrame:
    """Categories worth a filter: of ``low`` to ``high`` values and not plotted, the first ones."""
    found = profile.filter((F.col("semantic_type") == "categorical") & F.col("unique_count").between(low, high))
    if plotted:
        found = found.filter(~F.col("name").isin(*plotted))
    return found.orderBy("position").limit(limit)
