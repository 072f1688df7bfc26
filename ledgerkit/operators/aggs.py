"""Aggregations beyond a plain ``groupBy``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.functions.exprs import percent
from ledgerkit.operators import ordered

def by_period(df: DataFrame, ts: str, unit: str, *aggs: Column) -> DataFrame:
    """Group by a part of a time: year, month (with its year), day, hour or weekday."""
    parts = {
        "year": [F.year(ts).alias("year")],
        "month": [F.year(ts).alias("year"), F.month(ts).alias("month")],
        "day": [F.to_date(ts).alias("day")],
        "hour": [F.hour(ts).alias("hour")],
        "weekday": [F.dayofweek(ts).alias("weekday")],
    }
    return df.groupBy(*parts[unit]).agg(*(aggs or [F.count(F.lit(1)).alias("rows")]))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum per key with its share of the grand total; the total is that of the sums, so ``df`` is read once."""
    sums = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    whole = sums.agg(F.sum("total").alias("whole")).scalar()
    return sums.withColumn("share_pct", percent("total", whole))


def string_agg(
    df: DataFrame, keys: Sequence[str], col: str, sep: str = ",", distinct: bool = False,
) -> DataFrame:
    """``STRING_AGG`` in the order of the values: one row per key, whatever the list's length.

    Equal values reach the key's task as one row with their number. The text must fit one cell;
    for lists beyond that see ``ordered_items``.
    """
    n = F.lit(1) if distinct else F.count(F.lit(1))
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(n.cast("int").alias("n"))
    text = F.array_join(F.array_repeat(F.col(col).cast("string"), F.col("n")), sep)
    packed = counts.select(*keys, F.struct(F.col(col).alias("v"), text.alias("t")).alias("x"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["t"]), sep)
    return packed.groupBy(*keys).agg(joined.alias("items"))


def ordered_items(df: DataFrame, keys: Sequence[str], col: str) -> DataFrame:
    """The items of each key's list as rows with their position, for lists of any length."""
    return ordered.number_rows(df.filter(F.col(col).isNotNull()).select(*keys, col), keys, [col], "position")


def latency_percentiles(df: DataFrame, keys: Sequence[str], col: str, ps: Sequence[float]) -> DataFrame:
    return ordered.exact_percentiles(df, keys, col, {f"p{round(p * 100)}": p for p in ps})


def avg_last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """Average over the last ``n`` rows of each key (``order`` ascending in time)."""
    tail = ordered.top_per_group(df, keys, ordered.flipped(order), n)
    return tail.groupBy(*keys).agg(
        (F.sum(value).cast("double") / F.count(value)).alias("average"), F.count(value).alias("used")
    )
