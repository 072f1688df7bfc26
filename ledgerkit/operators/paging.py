"""Sorting, limits and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.operators import ordered

# Up to here a page is cut from a sorted head; deeper pages come from distributed row numbers.
HEAD_ROWS = 10_000


def order_by_label(df: DataFrame, col: str, labels: Sequence[str], *then: str) -> DataFrame:
    """Sort by the position of a label in a list, other labels last."""
    rank = F.lit(len(labels))
    for i, label in reversed(list(enumerate(labels))):
        rank = F.when(F.col(col) == label, i).otherwise(rank)
    return df.orderBy(rank, *ordered.sort_columns(then))


def top_n(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*ordered.sort_columns(order)).limit(n)


def page(df: DataFrame, order: Sequence[str], number: int, size: int) -> DataFrame:
    """One page (1-based) with page number, number of pages and number of rows."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    first = (number - 1) * size
    if first + size <= HEAD_ROWS:
        rows = df.orderBy(*ordered.sort_columns(order)).offset(first).limit(size)
    else:
        rows = ordered.number_rows(df, [], order, "__rn").filter(
            (F.col("__rn") > first) & (F.col("__rn") <= first + size)
        ).drop("__rn")
    return rows.select(
        "*", F.lit(number).cast("long").alias("page"),
        F.ceil(total / size).cast("long").alias("total_pages"), total.alias("total_rows"),
    )


def next_batch(df: DataFrame, key: str, last, n: int) -> DataFrame:
    """The next ``n`` rows after a key; the filter reaches the scan."""
    rest = df if last is None else df.filter(F.col(key) > last)
    return rest.orderBy(key).limit(n)
