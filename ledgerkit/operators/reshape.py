"""Pivot and unpivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerkit.functions.exprs import MONTH_NAMES, month_name
from ledgerkit.functions.predicates import in_range, in_year

def pivot_values(df: DataFrame, col: str) -> list:
    """The values that become columns, in order; at most Spark's own ``spark.sql.pivotMaxValues``."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in df.select(col).distinct().orderBy(col).limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more values than spark.sql.pivotMaxValues = {most}; give the values")
    return [v for v in found if v is not None]


def pivot(df: DataFrame, keys: Sequence[str], col: str, value: str, values=None) -> DataFrame:
    """Sum of ``value`` per key, one column per value of ``col``."""
    return df.groupBy(*keys).pivot(col, values or pivot_values(df, col)).sum(value)


def pivot_by_month(tx: DataFrame, keys: Sequence[str], year: int) -> DataFrame:
    """One column per month that occurs in the year, in calendar order."""
    rows = tx.filter(in_year("ts", year))
    months = pivot_values(rows.select(F.month("ts").alias("m")), "m")
    named = rows.withColumn("__month", month_name("ts"))
    return pivot(named, keys, "__month", "amount", [MONTH_NAMES[m - 1] for m in months])


def pivot_by_type(tx: DataFrame, lo, hi) -> DataFrame:
    """Per account, one column per transaction type of the period."""
    return pivot(tx.filter(in_range("ts", lo, hi)), ["account_id"], "type", "amount")


def to_attributes(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Columns to (attribute, value) rows as text; nulls give no row."""
    texts = df.select(*id_cols, *[F.col(c).cast("string").alias(c) for c in cols])
    long = texts.unpivot(list(id_cols), list(cols), "attribute", "value")
    return long.filter(F.col("value").isNotNull())
