"""Generated tables: date dimension, numbers, synthetic bank."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.functions.exprs import day_name, month_name, seeded, week_number, zero_pad
from ledgerkit.sources.bank import MONEY, Bank


def numbers(spark: SparkSession, n: int, start: int = 1) -> DataFrame:
    return spark.range(start, start + n).select(F.col("id").alias("n"))


def days(spark: SparkSession, lo: date, hi: date) -> DataFrame:
    """One row per day from ``lo`` to ``hi``, both included."""
    count = (hi - lo).days + 1
    return spark.range(count).select(F.date_add(F.lit(lo), F.col("id").cast("int")).alias("date"))


def date_dim(spark: SparkSession, lo: date, hi: date, holidays: dict[str, str] | None = None) -> DataFrame:
    """Date dimension. ``holidays`` maps 'MM-dd' to a name."""
    d = F.col("date")
    out = days(spark, lo, hi).select(
        d, F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
        F.dayofweek(d).alias("weekday"), day_name("date").alias("day_name"),
        month_name("date").alias("month_name"), F.quarter(d).alias("quarter"),
        week_number("date").alias("week"), F.dayofweek(d).isin(1, 7).alias("weekend"),
    )
    name = F.lit(None).cast("string")
    for key, label in (holidays or {}).items():
        name = F.when(F.date_format(d, "MM-dd") == key, label).otherwise(name)
    return out.select("*", name.isNotNull().alias("holiday"), name.alias("holiday_name"))


def month_days(spark: SparkSession, day: date) -> DataFrame:
    """All days of the month of a day."""
    first = day.replace(day=1)
    after = (first + timedelta(days=32)).replace(day=1)
    return days(spark, first, after - timedelta(days=1))


def business_days(df: DataFrame, ts: str, dim: DataFrame, year: int, month: int) -> DataFrame:
    """Rows on working days of a month, through the date dimension.

    One month of the dimension has at most 31 rows, so it is sent to the tasks.
    """
    working = dim.filter(
        (F.col("year") == year) & (F.col("month") == month) & ~F.col("weekend") & ~F.col("holiday")
    ).select(F.col("date").alias("__day"))
    return df.join(F.broadcast(working), F.to_date(ts) == F.col("__day"), "left_semi")


def gen_bank(spark: SparkSession, scale: float = 1.0, seed: int = 42, end: date = date(2024, 12, 31)) -> Bank:
    """Synthetic star by modulo rules: 10,000 clients, 25,000 accounts, 500,000 movements at 1."""
    n_clients, n_accounts, n_tx = (max(1, int(n * scale)) for n in (10_000, 25_000, 500_000))
    pick = lambda names, col: F.element_at(
        F.array(*[F.lit(n) for n in names]), (col % len(names) + 1).cast("int"))
    i = F.col("id") + 1
    clients = spark.range(n_clients).select(
        i.alias("client_id"), F.concat(F.lit("Client "), zero_pad(i, 8)).alias("name"),
        pick(["RETAIL", "PREMIUM", "CORPORATE"], i).alias("segment"),
        (i % 25).alias("branch_id"), (seeded(100_000, seed, "id") / 100).cast(MONEY).alias("credit"),
    )
    accounts = spark.range(n_accounts).select(
        i.alias("account_id"), (F.col("id") % n_clients + 1).alias("client_id"),
        F.when(i % 20 == 0, "P").otherwise("O").alias("state"),
        pick(["SAVINGS", "CURRENT", "TERM"], i).alias("type"),
        (seeded(10_000_000, seed + 1, "id") / 100).cast(MONEY).alias("balance"),
        F.date_sub(F.lit(end), (i % 2000).cast("int")).cast("timestamp_ntz").alias("opened"),
    )
    minutes = seeded(365 * 24 * 60, seed + 3, "id")
    tx = spark.range(n_tx).select(
        (F.col("id") % n_accounts + 1).alias("account_id"), F.lit(1).alias("line"),
        i.alias("part_id"), F.lit(1).cast("long").alias("supplier_id"),
        pick(["A", "N", "R"], i).alias("type"), F.when(i % 10 == 0, "O").otherwise("F").alias("state"),
        ((seeded(500_000, seed + 2, "id") + 100) / 100).cast(MONEY).alias("amount"),
        F.timestamp_add("MINUTE", -minutes, F.lit(end).cast("timestamp_ntz")).alias("ts"),
    )
    return Bank(clients, accounts, tx)


def gen_volume(spark: SparkSession, n: int, seed: int = 42, end: date = date(2024, 12, 31)) -> DataFrame:
    """``n`` movements with dates spread over the two years before ``end``."""
    return spark.range(n).select(
        F.col("id"), (seeded(1_000, seed, "id") + 1).alias("account_id"),
        (seeded(1_000_000, seed + 1, "id") / 100).cast(MONEY).alias("amount"),
        F.date_sub(F.lit(end), seeded(730, seed + 2, "id").cast("int")).alias("day"),
    )
