"""Predicates in the form that reaches the Parquet scan: the column bare, the work on the literal."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Moment = date | datetime | str


def moment(value: Moment) -> datetime:
    if isinstance(value, datetime):
        return value
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(value)


def literal(value: Moment) -> Column:
    """A text literal, so Spark casts it (not the column) to DATE, TIMESTAMP or TIMESTAMP_NTZ."""
    at = moment(value)
    plain = at.date().isoformat() if at == moment(at.date()) else at.isoformat(" ")
    return F.lit(plain)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def add_months(value: Moment, n: int) -> datetime:
    """DATEADD(MONTH): the day is cut to the length of the target month."""
    at = moment(value)
    year, month = divmod(at.year * 12 + at.month - 1 + n, 12)
    first_next = datetime(year + (month == 11), (month + 1) % 12 + 1, 1)
    last_day = (first_next - timedelta(days=1)).day
    return at.replace(year=year, month=month + 1, day=min(at.day, last_day))


def shift(value: Moment, n: int, unit: str) -> datetime:
    """DATEADD on the driver."""
    at = moment(value)
    if unit in ("month", "quarter", "year"):
        return add_months(at, n * {"month": 1, "quarter": 3, "year": 12}[unit])
    return at + timedelta(**{unit + "s": n})


def in_range(col: Column | str, lo: Moment, hi: Moment) -> Column:
    """Half-open ``[lo, hi)``."""
    c = _col(col)
    return (c >= literal(lo)) & (c < literal(hi))


def between_days(col: Column | str, first: Moment, last: Moment) -> Column:
    """Both days included in full, also when the column carries a time."""
    return in_range(col, first, shift(last, 1, "day"))


def in_year(col: Column | str, year: int) -> Column:
    return in_range(col, date(year, 1, 1), date(year + 1, 1, 1))


def in_month(col: Column | str, year: int, month: int) -> Column:
    first = date(year, month, 1)
    return in_range(col, first, add_months(first, 1))


def on_day(col: Column | str, day: Moment) -> Column:
    return in_range(col, day, shift(day, 1, "day"))


def last(col: Column | str, n: int, unit: str, as_of: Moment) -> Column:
    """The last ``n`` days, months, hours or minutes before ``as_of``, both ends included."""
    c = _col(col)
    return (c >= literal(shift(as_of, -n, unit))) & (c <= literal(as_of))


def older_than(col: Column | str, n: int, unit: str, as_of: Moment) -> Column:
    return _col(col) < literal(shift(as_of, -n, unit))


def like_filter(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """LIKE; a plain prefix, suffix or infix becomes the predicate Parquet can use."""
    body = pattern.strip("%")
    if body and not set(body) & set("%_\\"):
        if pattern == body + "%":
            return df.filter(F.col(col).startswith(body))
        if pattern == "%" + body:
            return df.filter(F.col(col).endswith(body))
        if pattern == "%" + body + "%":
            return df.filter(F.col(col).contains(body))
    return df.filter(F.col(col).like(pattern))


def null_or_eq(col: Column | str, value) -> Column:
    """``ISNULL(col, v) = v`` without wrapping the column."""
    c = _col(col)
    return c.isNull() | (c == F.lit(value))


def eq_typed(df: DataFrame, col: str, value) -> Column:
    """Equality with the literal cast to the column's type, never the other way round."""
    return F.col(col) == F.lit(value).cast(df.schema[col].dataType)


def any_of(df: DataFrame, col: str, values: Iterable) -> Column:
    kind = df.schema[col].dataType
    return F.col(col).isin([F.lit(v).cast(kind) for v in values])


def optional_filters(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """All the conditions that are given; None stands for a parameter left out."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def when_given(value, build) -> Column | None:
    return None if value is None else build(value)


# Predicates moved from a function of the column to the bare column.

def added_days_at_least(col: str, days: int, bound: Moment) -> Column:
    """``DATEADD(DAY, days, col) >= bound``."""
    return F.col(col) >= literal(shift(bound, -days, "day"))


def days_since_at_most(col: str, days: int, as_of: Moment) -> Column:
    """``DATEDIFF(DAY, col, as_of) <= days``; the difference counts midnights."""
    start_of_day = moment(moment(as_of).date())
    return F.col(col) >= literal(shift(start_of_day, -days, "day"))


def plus_greater(col: str, added, bound) -> Column:
    """``col + added > bound``."""
    return F.col(col) > F.lit(bound - added)


def prefix_is(col: str, text: str) -> Column:
    """``LEFT(col, n) = text`` or ``SUBSTRING(col, 1, n) = text``."""
    return F.col(col).startswith(text)


def joined_is(first: str, second: str, sep: str, text: str) -> Column:
    """``first + sep + second = text``: one equality pair per place where ``sep`` occurs."""
    parts = text.split(sep)
    pairs = [
        (F.col(first) == sep.join(parts[:i])) & (F.col(second) == sep.join(parts[i:]))
        for i in range(1, len(parts))
    ]
    return reduce(lambda a, b: a | b, pairs) if pairs else F.lit(False)
