"""Aggregates by a column: Top-N with an Others bucket, date resampling, order and limits."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.operators.filters import apply_filters
from slatework.operators.scratch import stored
from slatework.plans.spec import QueryResult, QuerySpec

_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
#: A time column with more distinct values than this is resampled.
MOST_TIMES = 100


def _named(c: str) -> Column:
    return F.col(f"`{c}`")


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def aggregate_of(c: Column, how: str, approximate: bool = False) -> Column:
    """One aggregate; a sum over nothing is 0. An exact median here keeps a group's values together
    (see :func:`grouped_medians`); an approximate one keeps a sketch of bounded size."""
    if how == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if how == "median":
        return F.percentile_approx(c, 0.5, 10_000) if approximate else F.median(c)
    return {"mean": F.avg, "count": F.count, "min": F.min, "max": F.max}[how](c)


def _y_names(spec: QuerySpec, label: str) -> dict[str, str]:
    """Result names of the ys; a y that is the label column too gets a name of its own."""
    return {y: y if y != label else f"{y}_{spec.aggregation}" for y in dict.fromkeys(spec.ys)}


#: Rows above which a group's exact median is narrowed down instead of gathering its values in a task.
LARGE_GROUP = 1_000_000


def grouped_medians(df: DataFrame, key: str, ys: list[str], large: int | None = None, bins: int = 256) -> DataFrame:
    """(key, ys...): the exact medians of numbers by a key, null where a group has no value.

    Groups of at most ``large`` rows are aggregated as usual. The few larger ones, no more than the
    rows over ``large``, are narrowed down side by side: counts by (group, bin of its range) are added up
    before they are shuffled, and each group's next range is that of the bin that holds its middle, until
    it has one value, or no more than ``large`` rows, which are sorted. So no task gathers the values of a large group. Without large groups,
    which one count tells, there is a single aggregate. NaN counts as missing."""
    large = LARGE_GROUP if large is None else large
    k, values = _named(key), {y: F.when(~F.isnan(_named(y).cast("double")), _named(y).cast("double")) for y in ys}
    rows = df.select(k.alias("_k"), *[v.alias(f"_{i}") for i, v in enumerate(values.values())])
    counts = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > large)
    usual = [F.median(f"_{i}").alias(f"_{i}") for i in range(len(ys))]
    named = [F.col("_k").alias(key), *[F.col(f"_{i}").alias(y) for i, y in enumerate(ys)]]
    if counts.isEmpty():
        return rows.groupBy("_k").agg(*usual).select(*named)
    crowded = stored(counts.select("_k", F.lit(True).alias("_large")), "crowded")
    split = rows.join(crowded, rows["_k"].eqNullSafe(crowded["_k"]), "left").drop(crowded["_k"])
    small = split.filter("_large is null").drop("_large").groupBy("_k").agg(*usual)
    most = crowded.select("_k")
    for i in range(len(ys)):
        found = _narrowed(split.filter("_large").select("_k", F.col(f"_{i}").alias("v")), bins, large).withColumnRenamed("m", f"_{i}")
        most = most.join(found.withColumnRenamed("_k", "_g"), F.col("_k").eqNullSafe(F.col("_g")), "left").drop("_g")
    return small.unionByName(most).select(*named)


def _narrowed(rows: DataFrame, bins: int, large: int) -> DataFrame:
    """(_k, m): exact medians of v by _k. A group's range, the rows in it and the middle's rank among them
    are a row of a small table that is written once a round, until no range has over ``large`` rows."""
    v, inf = F.col("v"), float("inf")
    finite = F.when(F.abs(v) != inf, v)
    state = rows.filter("v is not null").groupBy("_k").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("v").alias("n"), F.count(finite).alias("c"), F.count_if(v == -inf).alias("below"))
    state = state.withColumn("rank", F.floor((F.col("n") + 1) / 2).cast("long") - F.col("below"))
    end = F.when(F.col("rank") <= 0, -inf).when(F.col("rank") > F.col("c"), inf)
    state = stored(state.select("_k", F.coalesce(end, "lo").alias("lo"), F.coalesce(end, "hi").alias("hi"), "n", "c", "rank"), "ranges")

    def inside(ranges: DataFrame) -> DataFrame:
        return rows.join(ranges.withColumnRenamed("_k", "_g"), v.between(F.col("lo"), F.col("hi")) & F.col("_k").eqNullSafe(F.col("_g")))

    wide = (F.col("lo") < F.col("hi")) & (F.col("c") > large)
    while not state.filter(wide).isEmpty():
        span = F.col("hi") / 2 - F.col("lo") / 2
        part = F.when(span > 0, (v / 2 - F.col("lo") / 2) / span).otherwise(F.when(v == F.col("lo"), 0.0).otherwise(1.0))
        place = F.least(F.lit(bins - 1), F.floor(part * bins))
        counted = inside(state.filter(wide)).groupBy("_k", "n", "rank", place.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy("_k").orderBy("bin"))
        holding = counted.withColumn("upto", upto).filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
        state = stored(state.filter(~wide).unionByName(holding.select("_k", "lo", "hi", "n", "c", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))), "ranges")
    few = inside(state.filter("lo < hi")).groupBy("_k", "n", "rank").agg(F.sort_array(F.collect_list("v")).alias("values"))
    state = state.filter("lo = hi").select("_k", "n", "lo").unionByName(few.select("_k", "n", F.element_at("values", F.col("rank").cast("int")).alias("lo")))
    # of an even number of values the next one counts too: the same again, or the least above it
    found = state.select(F.col("_k").alias("_g"), "n", F.col("lo").alias("first"))
    after = rows.join(found, F.col("_k").eqNullSafe(F.col("_g"))).groupBy("_k", "n", "first").agg(F.count_if(v <= F.col("first")).alias("upto"), F.min(F.when(v > F.col("first"), v)).alias("next"))
    second = F.when((F.col("n") % 2 == 1) | (F.col("upto") > F.floor(F.col("n") / 2)), F.col("first")).otherwise(F.col("next"))
    whole = F.col("first") + second
    return after.select("_k", F.when(F.abs(whole) != inf, whole / 2).otherwise(F.col("first") / 2 + second / 2).alias("m"))


def grouped(df: DataFrame, x: Column, label: str, spec: QuerySpec) -> DataFrame:
    """A row per non-null x with all aggregates; one partial and one final aggregation, but for exact
    medians (:func:`grouped_medians`)."""
    names = _y_names(spec, label)
    rows = df.select(x.alias("_x"), *[_named(y).alias(n) for y, n in names.items()]).filter("_x is not null")
    if spec.aggregation == "median" and not spec.approximate:
        return grouped_medians(rows, "_x", list(names.values()))
    return rows.groupBy("_x").agg(*[aggregate_of(_named(n), spec.aggregation, spec.approximate).alias(n) for n in names.values()])


def time_label(c: Column, whole_days: bool) -> Column:
    """A time as text: only the date if every value is a midnight."""
    return F.date_format(c, "yyyy-MM-dd" if whole_days else "yyyy-MM-dd HH:mm:ss")


def period_label(c: Column, period: str) -> Column:
    """The year, the month, or the Monday-to-Sunday week of a time, as text."""
    if period == "week":
        monday = F.to_date(F.date_trunc("week", c))
        return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))
    return F.date_format(c, "yyyy" if period == "year" else "yyyy-MM")


def partials(names: list[str], how: str) -> list[Column]:
    """What is kept of each y so that aggregates of parts can be merged; medians cannot."""
    out = []
    for i, y in enumerate(names):
        c = _named(y)
        if how in ("sum", "mean"):
            out += [F.sum(c).alias(f"_a{i}"), F.count(c).alias(f"_b{i}")]
        else:
            out.append({"count": F.count, "min": F.min, "max": F.max}[how](c).alias(f"_a{i}"))
    return out


def merged(names: list[str], how: str) -> list[Column]:
    """The aggregates of :func:`partials`' parts."""
    final = {
        "sum": lambda a, b: F.coalesce(F.sum(a), F.lit(0)), "mean": lambda a, b: F.sum(a) / F.nullif(F.sum(b), F.lit(0)), "count": lambda a, b: F.sum(a),
        "min": lambda a, b: F.min(a), "max": lambda a, b: F.max(a),
    }[how]
    return [final(F.col(f"_a{i}"), F.col(f"_b{i}")).alias(y) for i, y in enumerate(names)]


def by_day(rows: DataFrame, x: str, names: list[str], how: str) -> DataFrame:
    """A row per day of a time with mergeable aggregates of the ys, and what tells how to show the times:
    the day's first and last one, whether all are midnights, and about how many different ones."""
    c = _named(x).cast("timestamp")
    day = F.date_trunc("day", c)
    facts = [F.min("_t").alias("_low"), F.max("_t").alias("_high"), F.bool_and(F.col("_t") == F.col("_day")).alias("_whole"), F.approx_count_distinct("_t", 0.05).alias("_about")]
    return rows.select(c.alias("_t"), day.alias("_day"), *[_named(y) for y in names]).filter("_t is not null").groupBy("_day").agg(*partials(names, how), *facts)


def period_of(low: int | None, high: int | None) -> str:
    """Years, months or weeks, by the microseconds of the first and the last time."""
    days = 0 if low is None else (high - low) // 86_400_000_000
    return "year" if days > 730 else "month" if days > 180 else "week"


def day_facts(days: DataFrame) -> tuple[bool | None, str, bool]:
    """(resample?, period, whole days?) from the small table of days. None where only the exact number of
    different times decides."""
    low, high, n, about, whole = days.agg(F.unix_micros(F.min("_low")), F.unix_micros(F.max("_high")), F.count(F.lit(1)), F.coalesce(F.sum("_about"), F.lit(0)), F.coalesce(F.bool_and("_whole"), F.lit(True))).first()
    many = True if n > MOST_TIMES or about > MOST_TIMES * 1.4 else False if whole or about < MOST_TIMES * 0.7 else None
    return many, period_of(low, high), bool(whole)


def time_facts(df: DataFrame, x: str) -> tuple[bool, str, bool]:
    """(resample?, period, whole days?) by one small aggregate. The distinct count is estimated, and
    counted exactly only if the estimate is near the threshold."""
    c = _named(x).cast("timestamp")
    low, high, about, whole = df.agg(F.unix_micros(F.min(c)), F.unix_micros(F.max(c)), F.approx_count_distinct(c, 0.05), F.bool_and(c == F.date_trunc("day", c))).first()
    many = about > MOST_TIMES
    if MOST_TIMES * 0.7 < about < MOST_TIMES * 1.4:
        many = different_times(df, x) > MOST_TIMES
    return many, period_of(low, high), bool(whole)


def different_times(df: DataFrame, x: str) -> int:
    return df.agg(F.count_distinct(_named(x).cast("timestamp"))).first()[0]


def timed(rows: DataFrame, spec: QuerySpec, days: DataFrame | None = None) -> tuple[DataFrame, str, str | None]:
    """(result, label, period or None): a time x by its values or, if there are over 100 different ones, by
    years, months or weeks.

    Rows are read once, into a row a day; range, period and result follow from that small table, which
    is written. Only a few different times within days, and medians, take another pass. ``days`` are
    such rows from elsewhere."""
    if spec.aggregation == "median":
        many, period, whole = time_facts(rows, spec.x)
    else:
        names = list(_y_names(spec, spec.x))
        days = days if days is not None else stored(by_day(rows, spec.x, names, spec.aggregation), "days")
        many, period, whole = day_facts(days)
        many = different_times(rows, spec.x) > MOST_TIMES if many is None else many
        if many or whole:
            label = f"{spec.x}_{period}" if many else spec.x
            x = period_label(F.col("_day"), period) if many else time_label(F.col("_day"), True)
            given = list(_y_names(spec, label).values())
            return days.groupBy(x.alias("_x")).agg(*merged(given, spec.aggregation)), label, period if many else None
    label = f"{spec.x}_{period}" if many else spec.x
    x = period_label(_named(spec.x), period) if many else time_label(_named(spec.x), whole)
    return grouped(rows, x, label, spec), label, period if many else None


def top_n(df: DataFrame, spec: QuerySpec, n: int) -> tuple[DataFrame, DataFrame]:
    """(result, kept labels): the n - 1 values of x with the largest sums of the first y, and all
    other rows under one label, if x has more than n values; else every value.

    Sums, counts, means and extremes are grouped once and their partials merged; a median takes a
    second pass over the rows. The ranked values, at most n + 1 rows, are the side broadcast. A
    null x joins the others if there are any, else it is left out. A y that is no number ranks by
    its count."""
    label = spec.x
    names = _y_names(spec, label)
    first = spec.ys[0]
    rank = F.sum(_named(first)) if _numeric(df, first) else F.count(_named(first))
    rows = df.select(_named(label).alias("_x"), *[_named(y) for y in names])
    partial: list[Column] = []
    for i, y in enumerate(names):
        c = F.col(f"`{y}`")
        if spec.aggregation in ("sum", "mean"):
            partial += [F.sum(c).alias(f"_a{i}"), F.count(c).alias(f"_b{i}")]
        elif spec.aggregation != "median":
            partial.append(aggregate_of(c, spec.aggregation).alias(f"_a{i}"))
    groups = rows.groupBy("_x").agg(rank.alias("_rank"), *partial)
    best = groups.filter("_x is not null").select("_x", "_rank").orderBy(F.desc_nulls_last("_rank"), "_x").limit(n + 1)
    order = Window.orderBy(F.desc_nulls_last("_rank"), "_x")
    best = best.select("_x", F.row_number().over(order).alias("_at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_all"))
    kept = best.filter(f"_all <= {n} or _at <= {n - 1}").select("_x", F.lit(True).alias("_kept"))
    source = rows if spec.aggregation == "median" else groups
    joined = source.join(F.broadcast(kept), "_x", "left")
    joined = joined.withColumns({"_other": F.col("_kept").isNull(), "_label": F.when(F.col("_kept"), F.col("_x").cast("string")).otherwise(spec.others_label)})

    def merged(i: int, name: str) -> Column:
        a, b = F.col(f"_a{i}"), F.col(f"_b{i}")
        how = spec.aggregation
        out = {"sum": lambda: F.coalesce(F.sum(a), F.lit(0)), "mean": lambda: F.sum(a) / F.sum(b), "count": lambda: F.sum(a), "min": lambda: F.min(a), "max": lambda: F.max(a), "median": lambda: aggregate_of(_named(name), "median", spec.approximate)}[how]()
        return out.alias(names[name])

    # a null x alone does not make a bucket
    real = F.max(F.col("_x").isNotNull())
    if spec.aggregation == "median":
        split = joined.groupBy("_label", "_other").agg(real.alias("_real")).filter("_real").select("_label", "_other")
        shown = joined.join(F.broadcast(split), ["_label", "_other"], "left_semi")
        if spec.approximate:
            out = shown.groupBy("_label").agg(*[merged(i, y) for i, y in enumerate(names)])
        else:
            out = grouped_medians(shown, "_label", list(names)).withColumnsRenamed(names)
    else:
        again = []
        for i, y in enumerate(names):
            if spec.aggregation in ("sum", "mean"):
                again += [F.sum(f"_a{i}").alias(f"_a{i}"), F.sum(f"_b{i}").alias(f"_b{i}")]
            else:
                again.append({"count": F.sum, "min": F.min, "max": F.max}[spec.aggregation](f"_a{i}").alias(f"_a{i}"))
        split = joined.groupBy("_label", "_other").agg(real.alias("_real"), *again).filter("_real")
        out = split.groupBy("_label").agg(*[merged(i, y) for i, y in enumerate(names)])
    return out.withColumnRenamed("_label", "_x"), kept.select(F.col("_x").cast("string").alias("label"))


def share_of_total(result: DataFrame, y: str, name: str = "share") -> DataFrame:
    """The rows of a (small, aggregated) result with y as a share of all rows' y."""
    return result.withColumn(name, _named(y) / F.sum(_named(y)).over(Window.partitionBy()))


def page(result: DataFrame, order: list[Column | str], number: int, rows: int = 10) -> DataFrame:
    """Page ``number`` (from 0) of a result in a total order. It sorts and keeps the pages before it too;
    :func:`page_after` does not."""
    return result.orderBy(*order).offset(number * rows).limit(rows)


def beyond(order: list[str], last: tuple) -> Column:
    """Rows after the one with the values ``last`` in an order of columns, descending where a name begins
    with a minus. Nulls come first in rising and last in falling order, as Spark sorts them. The first
    column has a bound of its own, which a scan can use."""
    after, equal, bound = F.lit(False), F.lit(True), None
    for name, value in zip(order, last, strict=True):
        c, down = _named(name.removeprefix("-")), name.startswith("-")
        if value is None:
            further = F.lit(False) if down else c.isNotNull()
            this = c.isNull()
        else:
            further = (c < F.lit(value)) | c.isNull() if down else c > F.lit(value)
            this = c == F.lit(value)
        if bound is None:
            bound = F.lit(True) if value is None else (c <= F.lit(value)) | c.isNull() if down else c >= F.lit(value)
        after, equal = after | (equal & further), equal & this
    return bound & after


def page_after(result: DataFrame, order: list[str], last: tuple | None = None, rows: int = 10) -> DataFrame:
    """The first rows of a result in a total order, or those after the row that had the values ``last``. Every
    page costs what the first one does: the key is a filter, and tasks keep as many rows as a page has."""
    found = result if last is None else result.filter(beyond(order, last))
    return found.orderBy(*[F.desc_nulls_last(f"`{c[1:]}`") if c.startswith("-") else F.asc_nulls_first(f"`{c}`") for c in order]).limit(rows)


def cursor(page: DataFrame, order: list[str]) -> tuple | None:
    """The values of a page's last row, from which the next page goes on; None if it has no rows."""
    rows = page.select(*[_named(c.removeprefix("-")).alias(f"_{i}") for i, c in enumerate(order)]).collect()
    return tuple(rows[-1]) if rows else None


def asked(df: DataFrame, spec: QuerySpec, semantic_types: Mapping[str, str], strict: bool, default_limit: int) -> tuple[QuerySpec, DataFrame, int, list[str]]:
    """(the request as it is answered, its rows, the limit, notes)."""
    spec.check(df)
    spec, notes = spec.enforce(semantic_types)
    if spec.aggregation not in ("count", "min", "max") and (text := [y for y in spec.ys if not _numeric(df, y)]):
        raise ValueError(f"{spec.aggregation} needs numbers, not {', '.join(text)}")
    rows, applied = apply_filters(df, spec.filters, strict)
    limit, warning = spec.rows(default_limit)
    return spec, rows, limit, [*notes, *applied, *([warning] if warning else [])]


def answered(rows: DataFrame, spec: QuerySpec, limit: int, notes: list[str], types: Mapping[str, str], groups: DataFrame | None = None) -> QueryResult:
    """The result of a request. ``groups`` are mergeable aggregates of its rows, by x or by day, where they
    are at hand already."""
    label, period, others, kept = spec.x, None, None, None
    time = isinstance(rows.schema[spec.x].dataType, _TIMES)
    if time:
        out, label, period = timed(rows, spec, groups)
        every = out
    else:
        names = _y_names(spec, label)
        every = grouped(rows, _named(spec.x), label, spec) if groups is None else groups.groupBy("_x").agg(*merged(list(names.values()), spec.aggregation))
        if spec.group_others and limit > 1:
            out, kept = top_n(rows, spec, limit)
            others = spec.others_label
        else:
            out = every.orderBy(F.desc_nulls_last(f"`{names[spec.ys[0]]}`"), "_x").limit(limit)
    names = _y_names(spec, label)
    shown = out.select(F.col("_x").cast("string").alias(label), *[_named(n) for n in names.values()])
    shown = shown.fillna(0, subset=[n for n in names.values() if isinstance(shown.schema[n].dataType, T.NumericType)])
    cut = shown.orderBy(_named(label)).limit(limit)
    by = spec.sort_by or ("label" if time or types.get(spec.x) in ("metric", "temporal") else "value")
    first = _named(names[spec.ys[0]])
    done = cut.orderBy(F.desc_nulls_last(first), _named(label)) if by == "value" else cut.orderBy(_named(label))
    return QueryResult(done, label, tuple(names.values()), tuple(notes), "Count of Records" if spec.aggregation == "count" else None, spec.x if period else None, period, others, shown if time else every, limit, kept)


def run_query(df: DataFrame, spec: QuerySpec, semantic_types: Mapping[str, str] | None = None, strict: bool = False, default_limit: int = 50) -> QueryResult:
    """Filter, resample or bucket, aggregate once, cut by label, then sort.

    A time x with over 100 distinct values becomes years, months or weeks (:func:`timed`);
    another x with more values than the limit is ranked instead: Top-N, with or without Others. The
    limit keeps the first labels in text order; the order asked for comes after. Without one, metrics
    and times are sorted by label, anything else by value. Missing values of the result are 0."""
    types = dict(semantic_types or {})
    spec, rows, limit, notes = asked(df, spec, types, strict, default_limit)
    return answered(rows, spec, limit, notes, types)


def others_last(result: QueryResult) -> DataFrame:
    """The result by label with the bucket at the end."""
    x = _named(result.x)
    return result.df.orderBy(F.when(x == result.others_label, 1).otherwise(0), x)


def summary_stats(df: DataFrame, ys: list[str], by: str | None = None) -> DataFrame:
    """Sample standard deviations of ys and correlations of all their pairs, in one pass."""
    aggs = [F.stddev_samp(_named(y)).alias(f"stddev_{y}") for y in ys]
    aggs += [F.corr(_named(a), _named(b)).alias(f"corr_{a}_{b}") for i, a in enumerate(ys) for b in ys[i + 1 :]]
    return df.groupBy(_named(by)).agg(*aggs) if by else df.agg(*aggs)
