"""Declarative requests, checked and rewritten on the driver before Spark plans anything."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

AGGREGATES = ("sum", "mean", "median", "count", "min", "max")
OPERATORS = ("eq", "contains", "gt", "lt", "gte", "lte")
#: The most rows of a result, the default number, and that of a request in words.
MAX_ROWS, DEFAULT_ROWS, SHORT_ROWS = 500, 50, 20


@dataclass(frozen=True)
class Filter:
    """Predicates on one column; those given are all to hold."""

    column: str
    operator: str | None = None
    value: Any = None
    values: tuple | None = None
    min_val: Any = None
    max_val: Any = None


@dataclass(frozen=True)
class QuerySpec:
    """Aggregate ``ys`` by ``x``."""

    x: str
    ys: tuple[str, ...]
    aggregation: str = "sum"
    filters: tuple[Filter, ...] = ()
    limit: int | None = None
    sort_by: str | None = None
    group_others: bool = False
    others_label: str = "Others"
    approximate: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "ys", (self.ys,) if isinstance(self.ys, str) else tuple(self.ys))
        object.__setattr__(self, "filters", tuple(self.filters))
        if self.aggregation not in AGGREGATES:
            raise ValueError(f"aggregation {self.aggregation!r} is not one of {', '.join(AGGREGATES)}")
        if self.sort_by not in (None, "value", "label"):
            raise ValueError(f"sort_by {self.sort_by!r} is neither value nor label")
        if not self.ys:
            raise ValueError("at least one y column is needed")

    def check(self, df: DataFrame) -> None:
        """ValueError if x or a y is not a column."""
        missing = [c for c in dict.fromkeys((self.x, *self.ys)) if c not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {', '.join(missing)}; there are {', '.join(df.columns)}")

    def with_filter(self, new: Filter) -> QuerySpec:
        """The request with ``new`` in place of any filter on the same column."""
        return replace(self, filters=(*(f for f in self.filters if f.column != new.column), new))

    def merge(self, extra: Iterable[Filter | Mapping[str, Any]], df: DataFrame) -> QuerySpec:
        """The request with further filters. A mapping that is malformed or whose value is not a
        scalar is left out; an unknown column or operator raises ValueError."""
        found = []
        for f in extra:
            if isinstance(f, Mapping):
                if not isinstance(f.get("column"), str) or set(f) - set(Filter.__dataclass_fields__):
                    continue
                if any(isinstance(f.get(k), (list, dict, set, tuple)) for k in ("value", "min_val", "max_val")):
                    continue
                f = Filter(**{**f, "values": tuple(f["values"]) if f.get("values") is not None else None})
            if f.column not in df.columns:
                raise ValueError(f"no such column: {f.column}")
            if f.operator is not None and f.operator not in OPERATORS:
                raise ValueError(f"no such operator: {f.operator}")
            found.append(f)
        return replace(self, filters=(*self.filters, *found))

    def enforce(self, semantic_types: Mapping[str, str]) -> tuple[QuerySpec, list[str]]:
        """Sums and means of identifiers or categories become counts, for all ys; and why."""
        odd = [y for y in self.ys if semantic_types.get(y) in ("identifier", "categorical")]
        if self.aggregation not in ("sum", "mean") or not odd:
            return self, []
        why = [f"{y} is {semantic_types[y]}: counted, as a {self.aggregation} of it has no meaning" for y in odd]
        return replace(self, aggregation="count"), why

    def rows(self, default: int = DEFAULT_ROWS) -> tuple[int, str | None]:
        """The number of result rows, and a warning if the request asked for more than allowed."""
        wanted = default if self.limit is None else self.limit
        if wanted < 0:
            raise ValueError(f"limit {wanted} is negative")
        if wanted == 0 or wanted > MAX_ROWS:
            return MAX_ROWS, f"at most {MAX_ROWS} rows are returned; filters narrow the data"
        return wanted, None


@dataclass(frozen=True)
class QueryResult:
    """A lazy result. ``x`` is the label column; ``base`` and ``period`` say what a resampled one
    stands for; ``uncut`` is the result before its limit; ``kept`` are the labels beside Others."""

    df: DataFrame
    x: str
    ys: tuple[str, ...]
    notes: tuple[str, ...] = ()
    y_label: str | None = None
    base: str | None = None
    period: str | None = None
    others_label: str | None = None
    uncut: DataFrame | None = field(default=None, repr=False)
    limit: int | None = None
    kept: DataFrame | None = field(default=None, repr=False)

    def capped(self) -> bool:
        """Whether the limit cut rows off: one small job over at most limit + 1 rows."""
        if self.uncut is None or self.limit is None:
            return False
        return self.uncut.limit(self.limit + 1).count() > self.limit

    def empty_note(self) -> str | None:
        """What to tell where no row matches the filters, else None: one small job."""
        return "no rows match the filters; relax them or widen their ranges" if self.df.isEmpty() else None
