"""From a result back to the rows behind it."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.operators.aggregate import page_after
from slatework.operators.filters import apply_filters
from slatework.operators.stats import TIMES
from slatework.plans.spec import Filter, QueryResult, QuerySpec


def drilldown(df: DataFrame, filters: Iterable[Filter], order: list[str], limit: int = 50, strict: bool = False, last: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` matching rows in ``order``, or those after the row with the values ``last``; a
    one-row table with the total number of matching rows). Nulls stay null. Both are lazy, so a caller
    pays for the count only if it is wanted."""
    rows, _ = apply_filters(df, filters, strict)
    return page_after(rows, order, last, limit), rows.agg(F.count(F.lit(1)).alias("total"))


def period_bounds(label: str, period: str) -> tuple[date, date]:
    """The first day of a period and the first after it."""
    if period == "week":
        monday = date.fromisoformat(label.split("/")[0])
        return monday, monday + timedelta(days=7)
    year, month = int(label[:4]), int(label[5:7]) if period == "month" else 1
    if period == "year":
        return date(year, 1, 1), date(year + 1, 1, 1)
    return date(year, month, 1), date(year + month // 12, month % 12 + 1, 1)


def point_predicate(df: DataFrame, result: QueryResult, label: str) -> Column:
    """Rows that a result's label stands for: equal values, or a half-open range of the time column
    for a period, a day or a second."""
    name = result.base or result.x
    kind = df.schema[name].dataType
    if isinstance(kind, TIMES):
        if result.base is not None:
            low, high = period_bounds(label, result.period)
        else:
            low = datetime.fromisoformat(label)
            high = low + (timedelta(days=1) if len(label) == 10 else timedelta(seconds=1))
        c = F.col(f"`{name}`")
        return (c >= F.lit(str(low)).cast(kind)) & (c < F.lit(str(high)).cast(kind))
    from slatework.operators.filters import compile_filters

    predicate, _ = compile_filters(df, [Filter(result.x, values=(label,))])
    return predicate


def drill_from_point(df: DataFrame, spec: QuerySpec, result: QueryResult, label: str) -> DataFrame:
    """The rows behind one label of ``result``, under the request's filters. The bucket stands for
    all rows whose x is not among the kept labels, null included; its few kept labels are the
    anti-joined side."""
    rows, _ = apply_filters(df, spec.filters)
    if result.others_label is not None and label == result.others_label and result.kept is not None:
        kept = F.broadcast(result.kept)
        return rows.join(kept, F.col(f"`{spec.x}`").cast("string") == kept["label"], "left_anti")
    return rows.filter(point_predicate(df, result, label))
