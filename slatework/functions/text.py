"""Expressions that read numbers, shares and dates from text, and that print values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The texts that a CSV reader takes as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

NUMBER = r"^[+-]?\d+(\.\d+)?$"
PERCENT = r"^\d+\.?\d*%$"
_FRACTION = "[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"

#: The date patterns in the order in which they are tried; None is an ISO 8601 cast.
DATE_PATTERNS = (
    None,
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d",
    "yyyy/M/d H:m:s", "yyyy/M/d",
    "M/d/yyyy H:m:s", "M/d/yyyy h:m:s a", "M/d/yyyy",
    "d/M/yyyy H:m:s", "d/M/yyyy",
    "d-M-yyyy H:m:s", "d-M-yyyy",
    "yyyy-M-d'T'H:m:s", f"yyyy-M-d'T'H:m:s{_FRACTION}",
    "yyyy-M-d'T'H:m:s[XXX][XX]", f"yyyy-M-d'T'H:m:s{_FRACTION}[XXX][XX]",
    "yyyy-M-d H:m:s[XXX][XX]", f"yyyy-M-d H:m:s{_FRACTION}[XXX][XX]",
    "yyyy MMM d h:m:s a",
    "d MMM yyyy H:m:s", "d MMM yyyy",
    "MMM d, yyyy",
    "MMM d yyyy H:m:s",
)


def stripped_number(c: Column) -> Column:
    """Text without currency symbols, commas and white space."""
    return F.regexp_replace(c, r"[\p{Sc},\s]", "")


def is_number(c: Column) -> Column:
    return stripped_number(c).rlike(NUMBER)


def to_number(c: Column) -> Column:
    """The number that a text spells, exponents allowed; null for any other text."""
    x = stripped_number(c)
    return F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), x.try_cast("double"))


def is_percent(c: Column) -> Column:
    return c.rlike(PERCENT)


def to_fraction(c: Column) -> Column:
    return F.replace(c, F.lit("%"), F.lit("")).try_cast("double") / 100


def shape(pattern: str, digits: str = r"\d+", year: str = r"\d{4,}", letters: str = r"\p{L}+", offset: str = r"[+-]\d\d(?::?\d\d)?") -> str:
    """A regular expression that every text of a date pattern fits, and few others do."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        n = len(pattern[at:]) - len(pattern[at:].lstrip(c))
        if c == "'":
            end = pattern.index("'", at + 1)
            out, n = out + re.escape(pattern[at + 1 : end]), end + 1 - at
        elif c in "[]":
            out, n = out + ("(?:" if c == "[" else ")?"), 1
        elif c in "yMdHhmsS" and not (c == "M" and n > 2):
            out += f"[+-]?{year if c == 'y' else digits}"
        elif c in "Ma":
            out += rf"{letters}\.?"
        elif c == "X":
            out += f"(?:Z|{offset})"
        else:
            out += re.escape(c * n)
        at += n
    return f"(?i)^{out}$"


#: Texts' outlines: a run of digits is an 8 if there are four or more, else a 9, and a run of letters is an a,
#: but for single letters that some pattern spells. What an outline fits is decided once for all texts
#: that have it.
_SPELLED = "TtZzEe"


def outline(c: Column) -> Column:
    runs = F.regexp_replace(F.regexp_replace(c, r"(?<!\d)\d{1,3}(?!\d)", "9"), r"\d{4,}", "8")
    return F.regexp_replace(runs, rf"[\p{{L}}&&[^{_SPELLED}]]\p{{L}}*|[{_SPELLED}]\p{{L}}+", "a")


_WHOLE, _PLAIN = r"^[+-]?\d{1,18}$", r"^[+-]?\d+(\.\d+)?$"


def outline_of_others(c: Column) -> Column:
    """The outline of texts with digits that are no plain numbers; null for all others, which need none."""
    return F.when(c.rlike(r"\d") & ~c.rlike(_PLAIN), outline(c))


def bare_outline(form: Column) -> Column:
    return F.regexp_replace(form, r"[\p{Sc},\s]", "")


#: For each of DATE_PATTERNS, what the outlines of its texts fit.
DATE_OUTLINES = tuple(r"^\s*[Tt]?[+-]?[89](?:[-:].*|\s*)$" if p is None else shape(p, "[89]", "8", f"[a{_SPELLED}]", "[+-][89](?::?9)?") for p in DATE_PATTERNS)


def text_kind(c: Column, form: Column | None = None, bare: Column | None = None) -> Column:
    """What a text may be: ``whole`` or ``number`` (as :func:`is_number`), ``spelled`` (only as
    :func:`to_number`), ``percent``, the outline of a date text, ``time`` (what a cast may take besides), or
    ``other``. Few different ones, however many texts there are. The outlines may be columns already."""
    form = outline_of_others(c) if form is None else form
    bare = bare_outline(form) if bare is None else bare
    short = (F.length(c) <= 18) | stripped_number(c).rlike(_WHOLE)
    dates = "|".join(f"(?:{p.removeprefix('(?i)')})" for p in DATE_OUTLINES[1:])
    kind = (
        F.when(bare.rlike(r"^[+-]?[89]+$"), F.when(short, "whole").otherwise("number"))
        .when(bare.rlike(r"^[+-]?[89]+\.[89]+$"), "number")
        .when(bare.rlike(r"^[+-]?([89]+\.?[89]*|\.[89]+)([eE][+-]?[89]+)?$"), "spelled")
        .when(form.rlike(r"^[89]\.?[89]?%$"), "percent")
        .when(form.rlike(f"(?i){dates}"), form)
        .when(form.rlike(DATE_OUTLINES[0]), "time")
        .otherwise("other")
    )
    plain = F.when(c.rlike(_WHOLE), "whole").when(c.rlike(_PLAIN), "number").otherwise("other")
    return F.when(form.isNull(), plain).otherwise(kind)


def to_time(c: Column, pattern: str | None) -> Column:
    """A timestamp by one of DATE_PATTERNS; null where it does not fit. Only texts of the pattern's
    shape are parsed, as a text that does not parse costs an exception."""
    return c.try_cast("timestamp") if pattern is None else F.when(c.rlike(shape(pattern)), F.try_to_timestamp(c, F.lit(pattern)))


def any_time(c: Column) -> Column:
    """A timestamp by the first pattern that fits."""
    return F.coalesce(*[to_time(c, p) for p in DATE_PATTERNS])


def title(c: Column) -> Column:
    """snake_case as a title."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def _fixed(c: Column, digits: int) -> Column:
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def display_value(c: Column, kind: str = "number", compact: bool = False) -> Column:
    """A number as text: currency in whole dollars, percentage times 100 with one decimal, and with
    ``compact`` thousands, millions and billions with one decimal and a letter, and no commas in currency.
    Null stays null."""
    x, size = c.cast("double"), F.abs(c.cast("double"))
    front = "$" if kind == "currency" else ""
    if kind == "percentage":
        return F.concat(_fixed(x * 100, 1), F.lit("%"))
    plain = F.format_number(x, 0) if kind == "currency" else F.regexp_replace(F.format_number(x, 3), r"\.?0+$", "")
    sign = F.when(x < 0, "-").otherwise("")
    plain = F.concat(sign, F.lit(front), F.regexp_replace(plain, "^-", ""))
    if not compact:
        return plain
    scaled = [F.concat(sign, F.lit(front), _fixed(size / unit, 1), F.lit(letter)) for unit, letter in ((1e9, "B"), (1e6, "M"), (1e3, "K"))]
    # below a thousand, but what rounds up to it has four digits
    rest = F.concat(sign, F.lit(front), _fixed(size, 0)) if kind == "currency" else plain
    return F.when(size >= 1e9, scaled[0]).when(size >= 1e6, scaled[1]).when(size >= 1e3, scaled[2]).when(x.isNotNull(), rest)
