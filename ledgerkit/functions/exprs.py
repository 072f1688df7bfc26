"""Scalar helpers where the ledger's rules differ from the Spark function of the same name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of days (Sunday first) and months.
DAY_NAMES = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]
MONTHS_ES = [
    "enero", "febrero", "marzo", "abril", "mayo", "junio",
    "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre",
]
# Style numbers of CONVERT and the pattern each stands for.
STYLES = {
    101: "MM/dd/yyyy", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy", 112: "yyyyMMdd",
    120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS",
}
# Date pattern and decimal mark per culture.
CULTURES = {
    "es-ES": ("d/M/yyyy", ","), "en-US": ("M/d/yyyy", "."),
    "de-DE": ("d.M.yyyy", ","), "iso": ("yyyy-M-d", "."),
}


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Null handling, ratios, tiers

def concat_skip_null(*cols: Column | str) -> Column:
    """CONCAT: a null adds nothing. Use ``F.concat`` for ``+``, where a null wins."""
    return F.concat(*[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def safe_div(a: Column | str, b: Column | str) -> Column:
    """Null instead of an error for a zero divisor."""
    return F.try_divide(_c(a), _c(b))


def percent(part: Column | str, whole: Column | str) -> Column:
    return F.try_divide(_c(part).cast("double") * 100.0, _c(whole).cast("double"))


def tier(col: Column | str, bounds: Sequence[tuple[float, str]], other: str) -> Column:
    """Label of the first (highest) bound the value reaches."""
    out = None
    for bound, label in bounds:
        hit = _c(col) >= F.lit(bound)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(other) if out is None else out.otherwise(other)


# Conversion

def try_date(col: Column | str, style: int | str = 120) -> Column:
    """TRY_CONVERT(DATE, text, style): null for text the style does not cover."""
    fmt = style if isinstance(style, str) else STYLES[style].split(" ")[0]
    return F.try_to_date(F.trim(_c(col)), fmt)


def try_number(col: Column | str, kind: str = "decimal(10,2)", grouping: str = "") -> Column:
    """TRY_CONVERT to a number after dropping the grouping mark; '' stays null."""
    text = F.trim(_c(col))
    if grouping:
        text = F.replace(text, F.lit(grouping), F.lit(""))
    return text.try_cast(kind)


def parse_date(col: Column | str, culture: str) -> Column:
    """TRY_PARSE(DATE): numeric form of the culture, for Spanish also '15 de enero de 2024'."""
    pattern, _ = CULTURES[culture]
    text = F.trim(_c(col))
    parsed = F.try_to_date(text, pattern)
    if culture != "es-ES":
        return parsed
    words = F.lower(text)
    names = F.create_map(*[x for i, m in enumerate(MONTHS_ES) for x in (F.lit(m), F.lit(i + 1))])
    shape = r"^(\d{1,2}) de ([a-z]+) de (\d{4})$"
    number = F.try_element_at(names, F.regexp_extract(words, shape, 2))
    spelled = F.try_to_date(
        F.concat_ws("-", F.regexp_extract(words, shape, 3), number.cast("string"),
                    F.regexp_extract(words, shape, 1)), "yyyy-M-d",
    )
    return F.coalesce(parsed, F.when(words.rlike(shape), spelled))


def parse_number(col: Column | str, culture: str, kind: str = "decimal(10,2)") -> Column:
    """TRY_PARSE(DECIMAL): the culture's own grouping and decimal marks."""
    mark = CULTURES[culture][1]
    grouping = "." if mark == "," else ","
    text = F.replace(F.trim(_c(col)), F.lit(grouping), F.lit(""))
    if mark != ".":
        text = F.replace(text, F.lit(mark), F.lit("."))
    return text.try_cast(kind)


# Text

def text_len(col: Column | str) -> Column:
    """LEN: trailing blanks do not count."""
    return F.length(F.rtrim(_c(col)))


def zero_pad(col: Column | str, width: int) -> Column:
    """RIGHT('000' + x, width)."""
    return F.right(F.concat(F.repeat(F.lit("0"), F.lit(width)), _c(col).cast("string")), F.lit(width))


def stuff(col: Column | str, start: int, length: int, new: str) -> Column:
    return F.overlay(_c(col), F.lit(new), F.lit(start), F.lit(length))


def items(col: Column | str, sep: str = ",") -> Column:
    """Parts of a separated list, trimmed, empty parts dropped."""
    parts = F.split(_c(col), F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")))
    return F.filter(F.transform(parts, lambda part: F.trim(part)), lambda part: part != "")


def money(col: Column | str, sign: str = "$") -> Column:
    """FORMAT 'C' as text; a last step, keep the number beside it."""
    c = _c(col)
    shown = F.concat(F.lit(sign), F.format_number(F.abs(c), 2))
    return F.when(c < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


# Dates

def date_diff(unit: str, start: Column | str, end: Column | str) -> Column:
    """DATEDIFF: the number of unit boundaries between two moments, not of full units."""
    a, b = _c(start), _c(end)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit == "year":
        return (F.year(b) - F.year(a)).cast("long")
    if unit == "quarter":
        return ((F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)).cast("long")
    if unit == "month":
        return months.cast("long")
    if unit == "day":
        return F.datediff(b, a).cast("long")
    if unit == "week":
        sunday = lambda c: F.floor((F.unix_date(c.cast("date")) + 4) / 7)
        return (sunday(b) - sunday(a)).cast("long")
    return F.timestamp_diff(unit.upper(), F.date_trunc(unit, a), F.date_trunc(unit, b))


def week_number(col: Column | str) -> Column:
    """DATEPART(WEEK): 1 January is in week 1, weeks start on Sunday."""
    day = _c(col)
    first = F.dayofweek(F.trunc(day, "year"))
    return F.floor((F.dayofyear(day) + first - 2) / 7).cast("int") + 1


def day_name(col: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.dayofweek(_c(col)))


def month_name(col: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), F.month(_c(col)))


def clock_seconds(col: Column | str) -> Column:
    """Run time stored as the number HHMMSS, in seconds."""
    c = _c(col)
    hours, minutes = F.floor(c / 10000), F.floor(c / 100) % 100
    return (hours * 3600 + minutes * 60 + c % 100).cast("long")


# Repeatable randomness

def seeded(n: int, seed: int, *cols: Column | str) -> Column:
    """A number in ``[0, n)`` that depends on the columns and the seed alone."""
    return F.pmod(F.xxhash64(*[_c(c) for c in cols], F.lit(seed)), F.lit(n)).cast("long")
