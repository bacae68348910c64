"""Column statistics: everything that one pass can give, and exact distinct counts where they matter."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float and double columns becomes null: missing is one thing."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def one_pass(df: DataFrame, wanted: Mapping[tuple[str, str], Column]) -> dict[tuple[str, str], object]:
    """Many aggregates, named by (column, statistic), in one job."""
    if not wanted:
        return {}
    row = df.agg(*[c.alias(f"_{i}") for i, c in enumerate(wanted.values())]).first()
    return dict(zip(wanted, row, strict=True))


def as_text(df: DataFrame, name: str) -> Column:
    """A column's values as text; both zeros are one."""
    x = col(name)
    return (x + 0.0 if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else x).cast("string")


def long_values(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(name, value): the non-null values of columns as text, from one scan."""
    names = list(names)
    texts = [as_text(df, c).alias(f"_{i}") for i, c in enumerate(names)]
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"_{i}").alias("value")) for i, c in enumerate(names)])
    return df.select(*texts).select(F.inline(pairs)).filter("value is not null")


def exact_distinct(df: DataFrame, names: Iterable[str]) -> dict[str, int]:
    """Exact non-null distinct counts in one job. Tasks drop repeats before the one shuffle."""
    names = list(names)
    if not names:
        return {}
    found = long_values(df, names).distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()
    return {c: 0 for c in names} | {r["name"]: r["n"] for r in found}


class Least:
    """The least distinct texts of a column in case-insensitive order, ``limit`` of them at most. Two of these
    merge into one by adding the texts of one to the other."""

    def __init__(self, limit: int):
        self.limit, self.keys = limit, []

    def add(self, texts: pa.Array) -> None:
        new = pc.unique(texts).drop_null()
        if len(self.keys) == self.limit:
            # a text beyond ASCII may change its length in lower case, so each is looked at
            new = new.filter(pc.or_(pc.less_equal(pc.ascii_lower(new), self.keys[-1][0]), pc.invert(pc.string_is_ascii(new))))
        if len(new):
            self.keys = sorted({*self.keys, *((v.lower(), v) for v in new.to_pylist())})[: self.limit]


def _least(found: dict[int, Least]) -> Iterator[pa.RecordBatch]:
    yield from (pa.RecordBatch.from_arrays([pa.array([i] * len(f.keys), pa.int32()), pa.array([v for _, v in f.keys], pa.string())], ["i", "value"]) for i, f in found.items() if f.keys)


def first_values(df: DataFrame, names: Iterable[str], limit: int = 20) -> dict[str, list[str]]:
    """The first ``limit`` distinct values of each column as text, in case-insensitive order.

    One scan: every task keeps the least ``limit`` values of each column and passes on those; they are
    merged the same way, a column in a task. No rows are sorted, exploded or shuffled."""
    names = list(names)
    if not names:
        return {}
    texts = [as_text(df, c).alias(f"_{i}") for i, c in enumerate(names)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {i: Least(limit) for i in range(len(names))}
        for batch in batches:
            for i, f in found.items():
                f.add(batch.column(i))
        yield from _least(found)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Least] = {}
        for batch in batches:
            which = batch.column(0).to_numpy()
            for i in np.unique(which).tolist():
                found.setdefault(i, Least(limit)).add(batch.column(1).filter(pa.array(which == i)))
        yield from _least(found)

    kind = "i int, value string"
    rows = df.select(*texts).mapInArrow(partial, kind).repartition("i").mapInArrow(merged, kind).collect()
    return {c: [r["value"] for r in rows if r["i"] == i] for i, c in enumerate(names)}


#: Items that a column's sketch of frequent values tracks, and how many of them it names.
TRACKED, NAMED = 8_192, 100


def frequent_bound(n: int) -> float:
    """The most that a sketch of TRACKED items may be wrong about a value's count among ``n``: 3.5 n over its
    map's size, the power of two of which 3/4 hold the items."""
    return 3.5 * n / (1 << math.ceil(math.log2(TRACKED / 0.75)))


def modes(df: DataFrame, names: Iterable[str]) -> dict[str, object]:
    """The commonest value of each column, the smallest of ties, None if there is none.

    One pass keeps a bounded sketch of frequent values of each column; a second counts exactly those that
    may be the commonest. A value that the sketch does not name occurs at most twice its bound, or
    less often than the last one named; a column where that does not decide has its values counted in
    groups, so that no task holds all of a column's."""
    names = list(names)
    if not names:
        return {}
    sketched = [c for c in names if isinstance(df.schema[c].dataType, _SKETCHED)]
    sketch = {c: F.expr(f"approx_top_k({_sql_name(c)}, {NAMED}, {TRACKED})") for c in sketched}
    seen = {(c, "top"): [] for c in names} | one_pass(df, {(c, k): a for c in names for k, a in {"n": F.count(col(c)), **({"top": sketch[c]} if c in sketch else {})}.items()})
    likely: dict[str, list[object]] = {}
    for c in names:
        found = [(r["item"], r["count"]) for r in seen[c, "top"] or [] if r["item"] is not None]
        best = max((k for _, k in found), default=0)
        likely[c] = [v for v, k in found if k >= best - frequent_bound(seen[c, "n"])]
    same = {(c, i): F.count_if(col(c) == literal(v, df.schema[c].dataType)) for c, values in likely.items() for i, v in enumerate(values)}
    counts = one_pass(df, same)
    out: dict[str, object] = {}
    for c in names:
        exact = sorted(((-counts[c, i], v) for i, v in enumerate(likely[c])), key=lambda x: x)
        named = seen[c, "top"] or []
        unnamed = max(2 * frequent_bound(seen[c, "n"]), named[-1]["count"] if len(named) == NAMED else 0)
        if exact and -exact[0][0] > unnamed:
            out[c] = exact[0][1]
        else:
            row = df.select(col(c).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "v").first()
            out[c] = row and row["v"]
    return out


#: Types whose frequent values a sketch can hold.
_SKETCHED = (T.StringType, T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def literal(value: object, kind: T.DataType) -> Column:
    """A collected value as a literal of its own type; one without a time zone is not shifted by any."""
    return F.lit(value.isoformat(sep=" ")).cast(kind) if isinstance(kind, T.TimestampNTZType) and value is not None else F.lit(value)


def _sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The exact k-th largest value: grouped counts over ever narrower ranges, each of at most
    ``bins`` rows at the driver. Infinities count as ends of the order. None if there are fewer than k
    values or k < 1; no column value may be NaN."""
    x, inf = F.col(column), float("inf")
    finite = F.when(F.abs(x) != inf, x)
    low, high, n, top, bottom = df.agg(F.min(finite), F.max(finite), F.count(x), F.count_if(x == inf), F.count_if(x == -inf)).first()
    if k < 1 or n < k:
        return None
    if k <= top or k > n - bottom:
        return inf if k <= top else -inf
    k -= top
    while low < high:
        # ranges beyond the largest double are measured by halves
        part = (x - F.lit(low)) / F.lit(high - low) if math.isfinite(high - low) else (x / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
        place = F.least(F.lit(bins - 1), F.floor(part * bins))
        found = df.filter(x.between(low, high)).groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()
        for row in sorted(found, key=lambda r: -r["b"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        low, high = row["lo"], row["hi"]
    return low


def median(df: DataFrame, name: str, n: int) -> float | None:
    """The exact median of a column's ``n`` values that are neither null nor NaN, as a double, by narrowing
    histograms. Between infinities of both signs it is NaN."""
    values = df.select(col(name).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    upper = kth_largest(values, "v", (n + 1) // 2)
    if upper is None or n % 2:
        return upper
    lower = kth_largest(values, "v", n // 2 + 1)
    return (upper + lower) / 2 if math.isfinite(upper + lower) else upper / 2 + lower / 2


def round_half_away(x: float, digits: int = 4) -> float:
    """``x`` to so many decimals as SQL's round gives it: halves of the scaled double go away from zero, where
    Python's round goes by the exact binary value. Infinities and NaN stay."""
    unit = 10.0**digits
    size = abs(x) * unit
    if not math.isfinite(size):
        return x
    whole = math.floor(size)
    return math.copysign((whole + (size - whole >= 0.5)) / unit, x)


def distinct_counts(df: DataFrame, bars: Mapping[str, Iterable[float]], about: Mapping[str, int]) -> dict[str, int]:
    """The estimates ``about``, replaced by exact counts for columns near one of their ``bars``."""
    near = [c for c, b in bars.items() if any(0.8 * x <= about[c] <= 1.25 * x for x in b)]
    return {**{c: about[c] for c in bars}, **exact_distinct(df, near)}
