"""Filters compiled to one boolean column."""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterable
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.plans.spec import OPERATORS, Filter

_COMPARE = {"gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le}
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _number(value: Any) -> float | int | None:
    try:
        x = float(value)
    except (TypeError, ValueError):
        return None
    if math.isnan(x):
        return None
    return int(x) if x.is_integer() and abs(x) < 2**63 else x


def _time(value: Any) -> str | None:
    """A time as text that Spark casts to any time type."""
    try:
        found = pd.to_datetime(str(value) if not isinstance(value, datetime) else value, errors="coerce")
    except (TypeError, ValueError):
        return None
    if found is pd.NaT or found is None:
        return None
    return str(found.tz_convert("UTC").tz_localize(None) if found.tzinfo else found)


def literal(value: Any, kind: T.DataType) -> Column | None:
    """The value as a literal of the column's own type, so that comparisons reach the scan; None if
    it is no such value."""
    if isinstance(kind, T.StringType):
        return F.lit(str(value))
    if isinstance(kind, T.BooleanType):
        named = {"true": True, "1": True, "false": False, "0": False}.get(str(value).lower())
        return None if named is None else F.lit(named)
    if isinstance(kind, _TIMES):
        text = _time(value)
        return None if text is None else F.lit(text).cast(kind)
    if isinstance(kind, T.NumericType):
        x = _number(value)
        if x is None or isinstance(kind, T.IntegralType) and not isinstance(x, int):
            return None
        return F.lit(x).try_cast(kind)
    return None


def _equals(c: Column, kind: T.DataType, values: list, notes: list[str]) -> Column:
    found = [(v, literal(v, kind)) for v in values if v is not None]
    notes += [f"{v!r} is no {kind.simpleString()} and matches nothing" for v, x in found if x is None]
    fit = [x for _, x in found if x is not None]
    if not fit:
        return F.lit(False)
    return c == fit[0] if len(fit) == 1 else c.isin(*fit)


def _compared(c: Column, kind: T.DataType, how: str, value: Any, name: str, notes: list[str]) -> Column | None:
    if isinstance(kind, _TIMES):
        text = _time(value)
        if text is None:
            notes.append(f"{name} {how} {value!r} was skipped: not a time")
            return None
        return _COMPARE[how](c, F.lit(text).cast(kind))
    x = _number(value)
    if x is None:
        notes.append(f"{name} {how} {value!r} was skipped: not a number")
        return None
    if isinstance(kind, T.StringType):
        c = c.try_cast("double")
    elif isinstance(kind, T.BooleanType):
        c = c.cast("int")
    elif not isinstance(kind, T.NumericType):
        notes.append(f"{name} {how} was skipped: {kind.simpleString()} has no order here")
        return None
    return _COMPARE[how](c, F.lit(x))


def compile_filters(df: DataFrame, filters: Iterable[Filter], strict: bool = False) -> tuple[Column | None, list[str]]:
    """(one predicate or None, notes). All predicates of all filters hold together; null never
    matches. Literals take the column's type, columns are not cast unless they are text. An unknown
    column or operator, or a null value, is skipped with a note; with ``strict`` it raises
    ValueError."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts: list[Column] = []
    notes: list[str] = []

    def skip(why: str) -> None:
        if strict:
            raise ValueError(why)
        notes.append(f"{why}: skipped")

    for f in filters:
        if f.column not in kinds:
            skip(f"no such column: {f.column}")
            continue
        c, kind = F.col(f"`{f.column}`"), kinds[f.column]
        wanted = [(f.operator, f.value)] if f.operator is not None else []
        wanted += [(how, v) for how, v in (("gte", f.min_val), ("lte", f.max_val)) if v is not None]
        for how, value in wanted:
            if how not in OPERATORS:
                skip(f"no such operator: {how}")
                continue
            if value is None:
                skip(f"{f.column} {how} has no value")
                continue
            if how == "eq":
                part = _equals(c, kind, [value], notes)
            elif how == "contains":
                part = F.lower(c.cast("string")).contains(str(value).lower())
            else:
                part = _compared(c, kind, how, value, f.column, notes)
            if part is not None:
                parts.append(part)
                notes.append(f"{f.column} {how} {value}")
        if f.values is not None:
            parts.append(_equals(c, kind, list(f.values), notes))
            notes.append(f"{f.column} in {', '.join(map(str, f.values))}")
    return (functools.reduce(operator.and_, parts) if parts else None), notes


def apply_filters(df: DataFrame, filters: Iterable[Filter], strict: bool = False) -> tuple[DataFrame, list[str]]:
    """The matching rows, and the notes of :func:`compile_filters`."""
    predicate, notes = compile_filters(df, filters, strict)
    return (df if predicate is None else df.filter(predicate)), notes
