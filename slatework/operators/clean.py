"""Header normalisation, type repair of text columns, missing values and imputation."""

from __future__ import annotations

import functools
import math
import operator
import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.functions.text import DATE_OUTLINES, DATE_PATTERNS, any_time, bare_outline, outline_of_others, stripped_number, text_kind, to_fraction, to_number, to_time
from slatework.operators.stats import col, distinct_counts, literal, median, modes, nan_to_null, one_pass, round_half_away
from slatework.operators.stats import is_number as is_numeric

#: Parts of names, wherever they stand in the lower-cased name.
CURRENCY_NAMES = ("amount", "price", "cost", "revenue", "income", "salary", "expense", "value", "total", "balance", "payment")
IDENTIFIER_FORMAT_NAMES = ("id", "code", "serial", "key", "number", "ref", "identifier")
PERCENTAGE_NAMES = ("percent", "pct", "rate", "ratio")
CODED_NAMES = ("id", "code", "key", "identifier")

LOG = "seq int, column string, action string, affected long"
MISSING = "column string, missing long"


@dataclass(frozen=True)
class Cleaned:
    """A repaired and filled table, with what was done to it."""

    df: DataFrame
    actions: tuple[tuple[str | None, str, int], ...]
    missing: Mapping[str, int]
    rows: int
    formats: Mapping[str, str]
    hints: Mapping[str, str]

    @property
    def quality(self) -> float:
        """100 less the share of missing cells, in percent."""
        return quality_score(sum(self.missing.values()), self.rows, len(self.df.columns))

    def cleaning_log(self) -> DataFrame:
        """(seq, column, action, affected), a row per action."""
        rows = [(i, *a) for i, a in enumerate(self.actions)]
        return self.df.sparkSession.createDataFrame(rows, LOG)

    def missing_counts(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(sorted(self.missing.items()), MISSING)


def quality_score(missing: int, rows: int, columns: int) -> float:
    return round(max(0.0, 100 - missing / max(rows * columns, 1) * 100), 1)


def has(name: str, parts: tuple[str, ...]) -> bool:
    return any(p in name.lower() for p in parts)


def normalize_header(name: str) -> str:
    """Lower snake_case; ``column`` if nothing is left."""
    return re.sub(r"_+", "_", re.sub(r"\W+", "_", name.strip().lower())).strip("_") or "column"


def unique_headers(names: list[str], rename: Mapping[str, str] | None = None) -> list[str]:
    """Normalised names, repeats with suffixes _2, _3 and so on, and never one that is taken."""
    wanted = [normalize_header((rename or {}).get(n, n)) for n in names]
    out: list[str] = []
    taken = set(wanted)
    for name in wanted:
        new, k = name, 2
        while new in out:
            new, k = f"{name}_{k}", k + 1
            while new in taken and new not in out:
                new, k = f"{name}_{k}", k + 1
        out.append(new)
    return out


def normalize_headers(df: DataFrame, rename: Mapping[str, str] | None = None) -> tuple[DataFrame, list[tuple[str | None, str, int]]]:
    """The table under normalised names, and the log of it."""
    names = unique_headers(df.columns, rename)
    changed = sum(a != b for a, b in zip(df.columns, names, strict=True))
    return df.toDF(*names), [(None, f"Normalized {changed} column headers", changed)] if changed else []


def _texts(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def text_kinds(df: DataFrame, texts: list[str]) -> dict[str, dict[tuple[str | None, bool], int]]:
    """For each text column the rows by (kind of text, whether it has a currency symbol), None for null: a
    histogram of a few kinds, from one partial aggregate over all columns."""
    if not texts:
        return {}
    values = F.array(*[F.struct(F.lit(i).alias("i"), col(c).alias("value")) for i, c in enumerate(texts)])
    # a step for each outline, so that none is made twice
    forms = df.select(F.inline(values)).withColumn("form", outline_of_others(F.col("value"))).withColumn("bare", bare_outline(F.col("form")))
    kind = F.when(F.col("value").isNotNull(), text_kind(*map(F.col, ("value", "form", "bare"))))
    kinds = forms.select("i", kind.alias("kind"), F.coalesce(F.col("value").rlike(r"\p{Sc}"), F.lit(False)).alias("symbol"))
    out: dict[str, dict[tuple[str | None, bool], int]] = {c: {} for c in texts}
    for row in kinds.groupBy("i", "kind", "symbol").agg(F.count(F.lit(1)).alias("n")).collect():
        out[texts[row["i"]]][row["kind"], row["symbol"]] = row["n"]
    return out


#: Kinds of texts that are no date outlines but may be cast to a time.
_CASTABLE = ("whole", "number", "spelled", "time")


def date_patterns(kinds: Mapping[str, int], n: int) -> list[tuple[int, int]]:
    """(pattern, how many values may fit at most) of a column of which enough values may be times."""
    fitting = {i: sum(k for form, k in kinds.items() if form in _CASTABLE and i == 0 or re.search(p, form)) for i, p in enumerate(DATE_OUTLINES)}
    could = sum(k for form, k in kinds.items() if form in _CASTABLE or any(re.search(p, form) for p in DATE_OUTLINES))
    return [(i, k) for i, k in fitting.items() if k] if could > 0.7 * n else []


def _parses(df: DataFrame, wanted: Mapping[str, list[int]], lazily: bool) -> dict[tuple[str, int | str], int]:
    """(column, pattern or "any") -> the values that parse. ``lazily``: by the first pattern, and by any of
    them, where a value that one parses is not tried by the next."""
    flags, counts = [], {}
    for j, (c, patterns) in enumerate(wanted.items()):
        if lazily:
            first = to_time(col(c), DATE_PATTERNS[patterns[0]])
            others = [to_time(col(c), DATE_PATTERNS[i]).isNotNull() for i in patterns[1:]]
            flags.append(first.isNotNull().alias(f"_{j}"))
            counts[c, patterns[0]] = F.count_if(F.col(f"_{j}"))
            counts[c, "any"] = F.count_if(F.when(F.col(f"_{j}"), True).otherwise(functools.reduce(operator.or_, others, F.lit(False))))
        else:
            flags += [to_time(col(c), DATE_PATTERNS[i]).isNotNull().alias(f"_{j}_{i}") for i in patterns]
            counts |= {(c, i): F.count_if(F.col(f"_{j}_{i}")) for i in patterns}
    return one_pass(df.select(*[col(c) for c in wanted], *flags), counts)


def date_fits(df: DataFrame, kinds: Mapping[str, Mapping[str, int]], n: Mapping[str, int], rows: Mapping[str, int]) -> dict[tuple[str, int | str], int]:
    """(column, pattern or "any") -> the values that parse, for the columns of which enough may.

    Only patterns that fit some outline are tried, and only values that have it are parsed; none if no
    column can be a time. A first pass tries the first pattern that enough values may have, and the
    others where it fails; where that pattern takes enough values, or all together too few, the column is
    decided, and only the others have their patterns counted one by one."""
    patterns = {c: found for c, k in kinds.items() if (found := date_patterns(k, n[c]))}
    if not patterns:
        return {}
    order = {c: sorted((i for i, _ in found), key=lambda i: (dict(found)[i] <= 0.7 * n[c], i)) for c, found in patterns.items()}
    fits = _parses(df, order, True)
    open_ = {c: found for c, found in order.items() if fits[c, found[0]] <= 0.7 * rows[c] and fits[c, "any"] > 0.7 * n[c]}
    return fits | (_parses(df, open_, False) if open_ else {})


#: The most kinds of texts that an observation of a column names.
OBSERVED = 1_000


def observing_kinds(df: DataFrame, texts: list[str], seen: Observation, *more: Column) -> DataFrame:
    """``df``, with what :func:`text_kinds` counts and ``more`` observed once it is computed: a sketch a
    column, exact as long as the column has fewer kinds than it tracks."""
    forms = {c: f"_form{i}" for i, c in enumerate(texts)}
    shaped = df.withColumns({f: outline_of_others(col(c)) for c, f in forms.items()}).withColumns({f"{f}_bare": bare_outline(F.col(f)) for f in forms.values()})
    counts = []
    for c, f in forms.items():
        kind = F.concat(F.when(col(c).rlike(r"\p{Sc}"), "$").otherwise("-"), text_kind(col(c), F.col(f), F.col(f"{f}_bare")))
        counts.append(F.call_function("approx_top_k", F.when(col(c).isNull(), "").otherwise(kind), F.lit(OBSERVED), F.lit(OBSERVED)).alias(c))
    return shaped.observe(seen, *more, *counts).select(*[col(c) for c in df.columns])


def kinds_from(observed: Mapping[str, list]) -> dict[str, dict[tuple[str | None, bool], int]] | None:
    """The counts of :func:`text_kinds` from observed values; None if a column has too many kinds."""
    out: dict[str, dict[tuple[str | None, bool], int]] = {}
    for c, items in observed.items():
        if len(items or []) >= OBSERVED:
            return None
        out[c] = {(r["item"][1:] or None if r["item"] else None, r["item"].startswith("$")): r["count"] for r in items or []}
    return out


def repair_types(df: DataFrame, kinds: Mapping[str, Mapping[tuple[str | None, bool], int]] | None = None) -> tuple[DataFrame, list[tuple[str | None, str, int]], dict[str, str]]:
    """Text columns whose values mostly spell numbers, percentages or times become those.

    One pass counts the kinds of texts in all columns; a second parses dates, only of columns of which
    enough values look like some and by the patterns that they look like. Values that do not convert
    become null. ``kinds`` are counts that are known already. Returns the table, the log and the formats
    that the text gave away."""
    kinds = text_kinds(df, _texts(df)) if kinds is None else kinds
    new: dict[str, Column] = {}
    log, formats, rest, rows, n = [], {}, {}, {}, {}
    for c, found in kinds.items():
        count = {k: sum(m for (kind, _), m in found.items() if kind == k) for k, _ in found}
        rows[c] = sum(count.values())
        n[c] = rows[c] - count.get(None, 0)
        whole, number = count.get("whole", 0), count.get("whole", 0) + count.get("number", 0)
        if n[c] and number > 0.5 * n[c]:
            new[c] = stripped_number(col(c)).cast("long") if whole == rows[c] else to_number(col(c))
            money = has(c, CURRENCY_NAMES) or sum(m for (_, symbol), m in found.items() if symbol) > 0.1 * n[c]
            log.append((c, f"Converted {c} from {'currency' if money else 'numeric'} text to numbers", number + count.get("spelled", 0)))
            if money:
                formats[c] = "currency"
        elif n[c] and count.get("percent", 0) > 0.5 * n[c]:
            new[c] = to_fraction(col(c))
            formats[c] = "percentage"
            log.append((c, f"Converted {c} from percent text to fractions", count["percent"]))
        elif n[c]:
            rest[c] = {k: m for k, m in count.items() if k not in (None, "other", "percent")}
    fits = date_fits(df, rest, n, rows)
    for c in rest:
        if fits.get((c, "any"), 0) <= 0.7 * n[c]:
            continue
        first = next((i for i in range(len(DATE_PATTERNS)) if fits.get((c, i), 0) > 0.7 * n[c]), None)
        if first is not None and fits[c, first] > 0.7 * rows[c]:
            new[c], done = to_time(col(c), DATE_PATTERNS[first]), fits[c, first]
        elif fits[c, "any"] > 0.7 * rows[c]:
            new[c], done = any_time(col(c)), fits[c, "any"]
        else:
            continue
        formats[c] = "date"
        log.append((c, f"Converted {c} from date text to timestamps", done))
    return (df.withColumns(new) if new else df), log, formats


def format_of(name: str, low: float | None, high: float | None) -> str:
    """The display format of a numeric column, by its name and then its range."""
    if has(name, IDENTIFIER_FORMAT_NAMES) and not has(name, CURRENCY_NAMES):
        return "identifier"
    if has(name, CURRENCY_NAMES):
        return "currency"
    if has(name, PERCENTAGE_NAMES):
        return "percentage"
    return "percentage" if low is not None and low >= 0 and high < 1 else "number"


def column_formats(df: DataFrame, parsed: Mapping[str, str], ranges: Mapping[str, tuple]) -> dict[str, str]:
    """Formats of all columns: numbers by :func:`format_of`, unless text gave more away."""
    out = dict(parsed)
    for f in df.schema.fields:
        if is_numeric(f.dataType):
            found = format_of(f.name, *ranges[f.name])
            if not (parsed.get(f.name) in ("currency", "percentage") and found == "number"):
                out[f.name] = found
    return out


def sample_skew(population: float | None, n: int) -> float:
    """Bias-corrected skewness; 0 for constant columns and for n of at most 2."""
    return 0.0 if n <= 2 or population is None or math.isnan(population) else population * math.sqrt(n * (n - 1)) / (n - 2)


def _coded(name: str, s: Mapping[str, object], hint: str | None, kind: str | None) -> bool:
    """Whether a numeric column holds codes rather than amounts."""
    if not s["n"] or kind in ("currency", "percentage"):
        return False
    if hint == "identifier":
        return True
    few = s["distinct"] <= max(20, int(s["n"] * 0.05))
    if s["whole"] <= 0.95 or not few:
        return False
    return has(name, CODED_NAMES) or hint == "categorical" and 1 - s["distinct"] / s["n"] >= 0.5


def impute(df: DataFrame, hints: Mapping[str, str] | None = None, parsed: Mapping[str, str] | None = None) -> Cleaned:
    """Fill missing numbers where that is safe; text, times and flags stay null.

    Codes get -1; values within 0 and 1 get 0 if that is at least 80 % of them, else their mode (the
    smallest of ties); confident metrics get the median if skewed, else the mean, to 4 decimals. All
    others stay null, and the log says so. One pass gives all statistics; exact distinct counts, and
    medians (by narrowing histograms) and modes (by grouped counts), are taken only for columns that
    need them."""
    hints, parsed = dict(hints or {}), dict(parsed or {})
    numbers = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    wanted = {("", "rows"): F.count(F.lit(1))} | {(c, "n"): F.count(col(c)) for c in df.columns}
    for c in numbers:
        x = col(c)
        wanted |= {(c, "min"): F.min(x), (c, "max"): F.max(x), (c, "distinct"): F.approx_count_distinct(x), (c, "zeros"): F.count_if(x == 0), (c, "whole"): F.avg((F.round(x) == x).cast("int")), (c, "mean"): F.avg(x), (c, "skew"): F.skewness(x)}
    seen = one_pass(df, wanted)
    rows = seen["", "rows"]
    missing = {c: rows - seen[c, "n"] for c in df.columns if rows > seen[c, "n"]}
    formats = column_formats(df, parsed, {c: (seen[c, "min"], seen[c, "max"]) for c in numbers})
    gaps = [c for c in numbers if c in missing]
    bars = {c: (20, seen[c, "n"] * 0.05, seen[c, "n"] * 0.2, seen[c, "n"] * 0.5) for c in gaps}
    exact = distinct_counts(df, bars, {c: seen[c, "distinct"] for c in gaps})
    fills: dict[str, float] = {}
    log, later = [], {}
    for c in gaps:
        s = {k: seen[c, k] for k in ("n", "min", "max", "zeros", "whole", "mean", "skew")} | {"distinct": exact[c]}
        n, k = s["n"], missing[c]
        sure = hints.get(c) == "metric" or n >= 0.7 * rows and n and s["whole"] <= 0.95 and s["distinct"] > 0.2 * n
        if _coded(c, s, hints.get(c), formats.get(c)):
            fills[c] = -1
            log.append((c, f"Filled {k} missing {c} values with -1 (codes)", k))
        elif n and s["min"] >= 0 and s["max"] <= 1:
            if s["zeros"] >= 0.8 * n:
                fills[c] = 0
                log.append((c, f"Filled {k} missing {c} values with 0 (bounded, mostly 0)", k))
            else:
                later[c] = "mode"
                log.append((c, f"Filled {k} missing {c} values with the mode (bounded)", k))
        elif n and sure and abs(sample_skew(s["skew"], n)) > 1:
            later[c] = "median"
            log.append((c, f"Filled {k} missing {c} values with the median (high-confidence metric)", k))
        elif n and sure and math.isnan(s["mean"]):
            log.append((c, f"Left {k} missing {c} values null (infinities of both signs have no mean)", k))
        elif n and sure:
            fills[c] = round_half_away(float(s["mean"]))
            what = "mean" if math.isfinite(fills[c]) else "mean, which is infinite"
            log.append((c, f"Filled {k} missing {c} values with the {what} (high-confidence metric)", k))
        else:
            log.append((c, f"Left {k} missing {c} values null (low-confidence imputation)", k))
    fills |= modes(df, [c for c, how in later.items() if how == "mode"])
    fills |= {c: round_half_away(median(df, c, seen[c, "n"])) for c, how in later.items() if how == "median"}
    wide = {c for c, v in fills.items() if isinstance(df.schema[c].dataType, T.IntegralType) and float(v) != int(v)}
    new = {c: F.coalesce(col(c).cast("double") if c in wide else col(c), F.lit(v) if c in wide else F.lit(v).cast(df.schema[c].dataType)) for c, v in fills.items()}
    return Cleaned(df.withColumns(new) if new else df, tuple(log), missing, rows, formats, hints)


def clean(df: DataFrame, rename: Mapping[str, str] | None = None, semantic_hints: Mapping[str, str] | None = None, kinds: list[Mapping[tuple[str | None, bool], int]] | None = None) -> Cleaned:
    """Headers, types, missing counts and imputation, in this order. Statistics are a few small
    jobs; the cleaned table itself is lazy. ``kinds`` are the kinds of texts by column, all of which are
    text then, if they are known already."""
    allowed = ("metric", "identifier", "temporal", "categorical")
    hints = {c: t for c, t in (semantic_hints or {}).items() if t in allowed}
    df, log = normalize_headers(nan_to_null(df), rename)
    df, repaired, parsed = repair_types(df, None if kinds is None else dict(zip(df.columns, kinds, strict=True)))
    done = impute(df, hints, parsed)
    return Cleaned(done.df, (*log, *repaired, *done.actions), done.missing, done.rows, done.formats, hints)


def quality(df: DataFrame, rename: Mapping[str, str] | None = None) -> float:
    """The quality score that :func:`clean` gives, without its other statistics: the types are repaired
    and missing cells counted, and nothing is filled."""
    df = repair_types(normalize_headers(nan_to_null(df), rename)[0])[0]
    rows, *counts = df.agg(F.count(F.lit(1)), *[F.count(col(c)) for c in df.columns]).first()
    return quality_score(sum(rows - n for n in counts), rows, len(df.columns))


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) of columns with missing values, from one aggregate."""
    counts = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column", "missing").filter("missing > 0")


def missing_report(counts: DataFrame, search: str = "") -> DataFrame:
    """Columns by missing values, most first, whose names contain ``search``."""
    return counts.filter(F.lower("column").contains(search.lower())).orderBy(F.desc("missing"), "column")


def search_log(log: DataFrame, search: str) -> DataFrame:
    """Actions that contain ``search``."""
    return log.filter(F.lower("action").contains(search.lower())).orderBy("seq")


def simple_impute(df: DataFrame) -> DataFrame:
    """Fill gaps: numbers with the mean to 2 decimals (0 if there is none), others with the
    mode, the smallest of ties (text: ``Unknown`` if there is none). Columns without gaps are not
    touched: one pass finds the gaps, a second the means, and grouped counts each mode."""
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))]
    gaps = one_pass(df, {(f.name, "gaps"): F.count_if(col(f.name).isNull()) for f in plain})
    plain = [f for f in plain if gaps[f.name, "gaps"]]
    seen = {c: v for (c, _), v in one_pass(df, {(f.name, "fill"): F.round(F.avg(col(f.name)), 2) for f in plain if is_numeric(f.dataType)}).items()}
    seen |= modes(df, [f.name for f in plain if not is_numeric(f.dataType)])
    new = {}
    for f in plain:
        v = seen[f.name]
        if v is None:
            v = 0 if is_numeric(f.dataType) else "Unknown" if isinstance(f.dataType, T.StringType) else None
        whole = isinstance(f.dataType, T.IntegralType) and v is not None and float(v) == int(v)
        if v is not None:
            c = col(f.name).cast("double") if isinstance(f.dataType, T.IntegralType) and not whole else col(f.name)
            new[f.name] = F.coalesce(c, literal(v, f.dataType) if not is_numeric(f.dataType) or not whole else F.lit(int(v)).cast(f.dataType))
    return df.withColumns(new) if new else df
