"""Shared by the registered queries: result types both engines agree on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.operators import ordered
from ledgerkit.session import tune
from ledgerkit.sources import bank as bank_views

AS_OF = "2001-12-01"
EVENTS_AS_OF = "2024-01-31"


def flat(df: DataFrame) -> DataFrame:
    """Decimals as doubles, doubles to four places, integers as BIGINT, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 4)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """Adds the place of each row in the frame's own order; rows with equal ``keys`` share the first place.

    Beside the SQL's ``rank() OVER (ORDER BY keys)`` it fails when the frame is sorted otherwise.
    """
    numbered = ordered.number_rows(df.withColumn("__at", F.monotonically_increasing_id()), [], ["__at"], "__n")
    return numbered.withColumn("position", F.min("__n").over(Window.partitionBy(*keys))).drop("__at", "__n")


def bank(spark, folder):
    return bank_views.bank(tune(spark), folder)


def on_bank(fn):
    """A query over the bank star."""
    return lambda spark, folder: flat(fn(bank(spark, folder)))


def on_tables(fn):
    """A query over the tables of the folder."""
    return lambda spark, folder: flat(fn(tune(spark), folder))
