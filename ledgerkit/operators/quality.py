"""Cleansing, validation and profiling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.functions.exprs import parse_date, parse_number, percent, try_date, try_number
from ledgerkit.session import settle
from ledgerkit.sources.readers import append_rows

# Culture per country code; other countries use the ISO forms.
COUNTRIES = {"ES": "es-ES", "US": "en-US", "DE": "de-DE"}


@dataclass(frozen=True)
class Field:
    """A text column to convert: kind ``date``, ``email`` or a SQL number type."""

    name: str
    kind: str
    error: str
    required: bool = False
    style: int | str = "yyyy-MM-dd"
    grouping: str = ""

    def converted(self) -> Column:
        if self.kind == "date":
            return try_date(self.name, self.style)
        if self.kind == "email":
            return F.when(F.col(self.name).like("%@%.%"), F.col(self.name))
        return try_number(self.name, self.kind, self.grouping)


def clean_import(df: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Converted columns beside the text, and the first failing rule as ``status``.

    Empty text counts as no value; a null in a required column is ``NULL_DATA``.
    """
    out = df.withColumns({f.name + "_value": f.converted() for f in fields})
    status = F.lit("OK")
    missing = [F.col(f.name).isNull() for f in fields if f.required]
    for m in reversed(missing):
        status = F.when(m, "NULL_DATA").otherwise(status)
    for f in reversed(fields):
        bad = F.col(f.name + "_value").isNull() & F.col(f.name).isNotNull() & (F.col(f.name) != "")
        status = F.when(bad, f.error).otherwise(status)
    return out.withColumn("status", status)


def error_summary(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def parse_by_country(df: DataFrame, country: str, date_text: str, amount_text: str) -> DataFrame:
    """Date and amount read in the culture of the row's country."""
    day, amount = parse_date(date_text, "iso"), parse_number(amount_text, "iso")
    for code, culture in COUNTRIES.items():
        own = F.col(country) == code
        day = F.when(own, parse_date(date_text, culture)).otherwise(day)
        amount = F.when(own, parse_number(amount_text, culture)).otherwise(amount)
    out = df.withColumns({"day": day, "amount": amount})
    return out.withColumn("status", F.when(F.col("day").isNull(), "ERROR").otherwise("OK"))


def conversion_by_country(parsed: DataFrame, country: str) -> DataFrame:
    return parsed.groupBy(country).agg(
        F.count(F.lit(1)).alias("total"), F.count("day").alias("succeeded"),
        F.count_if(F.col("day").isNull()).alias("failed"),
    )


def validate_split(
    df: DataFrame, rules: Sequence[tuple[str, Column]],
    refs: Sequence[tuple[str, DataFrame, str, str]] = (),
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with the first ``reason``).

    A rule is (reason, condition that must hold); a reference is (reason, table, column, key).
    A condition that is null counts as failed.
    """
    marked, checks = df, [(why, F.coalesce(ok, F.lit(False))) for why, ok in rules]
    for i, (why, table, column, key) in enumerate(refs):
        known = table.select(F.col(key).alias("__ref")).distinct().withColumn(f"__ok{i}", F.lit(True))
        marked = marked.join(known, F.col(column) == F.col("__ref"), "left").drop("__ref")
        checks.append((why, F.col(f"__ok{i}").isNotNull()))
    reason = F.lit(None).cast("string")
    for why, ok in reversed(checks):
        reason = F.when(~ok, why).otherwise(reason)
    marked = marked.withColumn("reason", reason).drop(*[f"__ok{i}" for i in range(len(refs))])
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


class TooManyErrors(RuntimeError):
    """The share of bad rows is over the bound; nothing was written."""


def migrate(
    source: DataFrame, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]], path: str,
    max_error_rate: float = 0.05, run: int = 1,
) -> DataFrame:
    """Split, check the error rate, then write the valid rows of a run; returns the stage report.

    The split is evaluated once, into a settled copy. The rows go to the folder of the run's
    number, so a run that is repeated replaces its rows.
    """
    good, bad = split(source)
    copy = settle(good.withColumn("__good", F.lit(True)).unionByName(
        bad.withColumn("__good", F.lit(False)), allowMissingColumns=True))
    counts = copy.agg(F.count(F.lit(1)).alias("total"), F.count_if("__good").alias("good")).first()
    failed = counts["total"] - counts["good"]
    if counts["total"] and failed / counts["total"] > max_error_rate:
        raise TooManyErrors(f"{failed} of {counts['total']} rows are bad")
    copy.filter("__good").select(*good.columns).write.mode("overwrite").parquet(f"{path}/run={run}")
    return source.sparkSession.createDataFrame(
        [("read", counts["total"]), ("rejected", failed), ("written", counts["good"])],
        "stage string, rows long")


def stage_and_load(df: DataFrame, trim: Sequence[str], required: Sequence[str], path: str) -> DataFrame:
    """Trim text, drop rows with a null in a required column, append; returns what was written."""
    clean = df.withColumns({c: F.trim(F.col(c)) for c in trim}).dropna(subset=list(required))
    append_rows(clean, path)
    return clean


def orphans(child: DataFrame, parent: DataFrame, fk: str, key: str) -> DataFrame:
    """Rows whose foreign key has no parent; a null key is no orphan."""
    keys = parent.select(F.col(key).alias("__key"))
    return child.filter(F.col(fk).isNotNull()).join(keys, F.col(fk) == F.col("__key"), "left_anti")


def dup_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def assert_none(df: DataFrame, cond: Column, message: str = "rows found") -> None:
    """Fail when any row meets the condition."""
    if df.filter(cond).limit(1).count():
        raise ValueError(message)


# Largest whole number per type and its bytes.
WHOLE = [("smallint", 32_767, 2), ("int", 2_147_483_647, 4), ("bigint", 9_223_372_036_854_775_807, 8)]


def profile_types(df: DataFrame) -> DataFrame:
    """Per column: nulls, longest text, largest number, narrowest type and its bytes.

    One pass over the table whatever the number of columns.
    """
    aggs, plan = [F.count(F.lit(1)).alias("n")], []
    for i, f in enumerate(df.schema.fields):
        c, kind = F.col(f.name), f.dataType
        whole = isinstance(kind, (T.IntegralType, T.BooleanType))
        number = isinstance(kind, T.NumericType) and not whole
        size = F.abs(c.cast("decimal(38,6)")) if number else F.abs(c.cast("decimal(20,0)")) if whole else F.length(c.cast("string"))
        aggs += [F.count(c).alias(f"c{i}"), F.max(size).cast("decimal(38,6)").alias(f"m{i}")]
        aggs.append((F.max(F.when(c.cast("decimal(38,6)") != F.floor(c.cast("decimal(38,6)")), 1).otherwise(0))
                     if number else F.lit(0)).alias(f"f{i}"))
        plan.append((i, f.name, kind.simpleString(), "whole" if whole else "number" if number else
                     "text" if isinstance(kind, T.StringType) else "other"))
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("column"), F.lit(kind).alias("type"), F.lit(group).alias("group"),
            (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.col(f"m{i}").alias("largest"),
            F.col(f"f{i}").alias("fraction"),
        ) for i, name, kind, group in plan
    ])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    narrow, width = F.lit("bigint"), F.lit(8)
    for name, top, size in reversed(WHOLE):
        narrow = F.when(F.col("largest") <= top, name).otherwise(narrow)
        width = F.when(F.col("largest") <= top, size).otherwise(width)
    as_whole = (F.col("group") == "whole") | ((F.col("group") == "number") & (F.col("fraction") == 0))
    text = F.concat(F.lit("varchar("), F.greatest(F.col("largest"), F.lit(1)).cast("long").cast("string"), F.lit(")"))
    return r.select(
        "column", "type", "nulls", F.col("largest").cast("double").alias("largest"),
        F.when(as_whole, narrow).when(F.col("group") == "text", text).when(
            F.col("group") == "number", "decimal(18,2)").otherwise(F.col("type")).alias("proposed"),
        F.when(as_whole, width).when(F.col("group") == "text", F.col("largest").cast("int")).otherwise(8)
        .cast("long").alias("bytes"),
    )


def error_share(cleaned: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("status") != "OK")
    return cleaned.agg(
        F.count(F.lit(1)).alias("rows"), bad.alias("bad"), percent(bad, F.count(F.lit(1))).alias("bad_pct"))
