"""Updates, merges, deletes, archiving and restartable batches.

Parquet tables cannot be changed in place, so each function returns the new rows; write them to
a new path and swap. Frames must be read from a place that is not being overwritten.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.functions import predicates as p
from ledgerkit.functions.exprs import date_diff, safe_div, tier
from ledgerkit.operators import ordered


def update_where(df: DataFrame, cond: Column, changes: Mapping[str, Column]) -> DataFrame:
    """``UPDATE … SET … WHERE``. A null condition leaves the row as it is."""
    return df.withColumns({
        c: F.when(cond, new.cast(df.schema[c].dataType)).otherwise(F.col(c))
        for c, new in changes.items()
    })


def delete_where(df: DataFrame, cond: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted); a null condition keeps the row."""
    hit = F.coalesce(cond, F.lit(False))
    return df.filter(~hit), df.filter(hit)


def assert_unique(source: DataFrame, keys: Sequence[str]) -> None:
    """Refuse a source with the same key twice."""
    if source.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"source has more than one row for a value of {list(keys)}")


class Merge(NamedTuple):
    target: DataFrame
    actions: DataFrame


def upsert(
    target: DataFrame, source: DataFrame, keys: Sequence[str], cols: Sequence[str],
    on_missing: str = "keep", active: str = "active", check: bool = True,
) -> Merge:
    """``MERGE``: the new target and one row per insert, update, deactivation or deletion.

    Matched rows change only where a value differs, nulls compared as values. Rows missing in
    the source are kept, deleted or deactivated. A key that is twice in the source is an error.
    """
    if on_missing not in ("keep", "delete", "deactivate"):
        raise ValueError(on_missing)
    if check:
        assert_unique(source, keys)
    old = target.withColumnsRenamed({c: "t_" + c for c in target.columns}).withColumn("in_t", F.lit(True))
    new = source.select(*keys, *cols).withColumnsRenamed(
        {c: "s_" + c for c in (*keys, *cols)}).withColumn("in_s", F.lit(True))
    on = reduce(lambda a, b: a & b, [F.col("t_" + k) == F.col("s_" + k) for k in keys])
    both = old.join(new, on, "full_outer")
    differs = reduce(
        lambda a, b: a | b, [~F.col("t_" + c).eqNullSafe(F.col("s_" + c)) for c in cols])
    gone = F.lit({"keep": "KEEP", "delete": "DELETE", "deactivate": "DEACTIVATE"}[on_missing])
    if on_missing == "deactivate":
        gone = F.when(F.col("t_" + active), gone).otherwise("KEEP")
    action = (
        F.when(F.col("in_t").isNull(), "INSERT").when(F.col("in_s").isNull(), gone)
        .when(differs, "UPDATE").otherwise("KEEP")
    )
    both = both.withColumn("action", action)
    from_source = F.col("action").isin("INSERT", "UPDATE")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce("t_" + c, "s_" + c)
        if c in cols:
            return F.when(from_source, F.col("s_" + c)).otherwise(F.col("t_" + c))
        if c == active:
            return F.when(F.col("action") == "INSERT", True).when(
                F.col("action") == "DEACTIVATE", False).otherwise(F.col("t_" + c))
        return F.col("t_" + c)

    result = both.filter(F.col("action") != "DELETE").select(
        *[value(c).cast(target.schema[c].dataType).alias(c) for c in target.columns])
    changed = both.filter(F.col("action") != "KEEP")
    actions = changed.select(
        *[value(k).alias(k) for k in keys], "action",
        *[F.when(F.col("action") != "INSERT", F.col("t_" + c)).alias("deleted_" + c) for c in cols],
        *[F.when(from_source, F.col("s_" + c)).alias("inserted_" + c) for c in cols],
    )
    return Merge(result, actions)


def resegment(clients: DataFrame, accounts: DataFrame, bounds, other: str) -> DataFrame:
    """Segment of every client from the sum of its balances; clients without accounts keep theirs."""
    sums = accounts.groupBy("client_id").agg(F.sum("balance").alias("__sum"))
    joined = clients.join(sums, "client_id", "left")
    label = F.when(F.col("__sum").isNotNull(), tier("__sum", bounds, other))
    return joined.withColumn("segment", F.coalesce(label, "segment")).drop("__sum")


def apply_net(accounts: DataFrame, tx: DataFrame, deposit: str) -> DataFrame:
    """Add each account's deposits less everything else of ``tx`` to its balance."""
    signed = F.when(F.col("type") == deposit, F.col("amount")).otherwise(-F.col("amount"))
    net = tx.groupBy("account_id").agg(F.sum(signed).alias("__net"))
    joined = accounts.join(net, "account_id", "left")
    added = F.col("balance") + F.coalesce("__net", F.lit(0).cast("decimal(28,2)"))
    return joined.withColumn("balance", added.cast("decimal(18,2)")).drop("__net")


def renumber(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    return ordered.number_rows(df, [], order, name)


def archive_older(
    df: DataFrame, archive: DataFrame, keys: Sequence[str], ts: str, cutoff,
) -> tuple[DataFrame, DataFrame]:
    """(rows to append to the archive, rows that stay). Rows archived before are not added twice."""
    stay, old = delete_where(df, F.col(ts) < p.literal(cutoff))
    return old.join(archive.select(*keys).distinct(), list(keys), "left_anti"), stay


def mark_inactive(accounts: DataFrame, tx: DataFrame, days: int, as_of, state: str = "I") -> DataFrame:
    """State of accounts without a movement for ``days`` days, or without any."""
    last = tx.groupBy("account_id").agg(F.max("ts").alias("last_tx"))
    joined = accounts.join(last, "account_id", "left")
    idle = F.col("last_tx").isNull() | p.older_than("last_tx", days, "day", as_of)
    return update_where(joined, idle, {"state": F.lit(state)})


# Restartable batches

BATCHES_PER_JOB = 100
MAX_JOBS = 10  # of one run; with more batches than these jobs hold, a job takes more of them
STATE_SCHEMA = "batch long, last_key string, rows long, state string"


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The finished batches of a run (empty for a new path)."""
    try:
        return spark.read.schema(STATE_SCHEMA).parquet(path + "/state/*")
    except AnalysisException:
        return spark.createDataFrame([], STATE_SCHEMA)


def batch_bounds(df: DataFrame, key: str, size: int) -> list:
    """Upper key of each batch of about ``size`` rows, in the key's own type, from one pass."""
    row = df.agg(F.count(key).alias("n"), F.max(key).alias("top")).first()
    if not row["n"]:
        return []
    wanted = math.ceil(row["n"] / size)
    if wanted < 2:
        return [row["top"]]
    probs = ", ".join(f"{i / wanted!r}D" for i in range(1, wanted))
    cuts = df.agg(F.percentile_approx(key, F.expr(f"array({probs})"), max(10_000, 4 * wanted))).first()[0]
    return sorted({*cuts, row["top"]})


def _below(value: Column, bounds: Sequence[Column]) -> Column:
    """How many of the ascending ``bounds`` lie below the value, by binary search."""
    if not bounds:
        return F.lit(0)
    table = F.array(*bounds)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(table, F.least(at + step, F.lit(len(bounds))) - 1) < value), at + step).otherwise(at))


def _rows_written(spark: SparkSession, path: str, numbers: Sequence[int]) -> dict[int, int]:
    """Rows of each of these batches; other batches' files are not listed. A batch without rows has no folder."""
    wanted = ",".join(map(str, numbers))
    try:
        files = spark.read.schema("batch long").option("basePath", f"{path}/data").parquet(f"{path}/data/batch={{{wanted}}}")
    except AnalysisException:  # none of them has rows
        return {}
    return {r["batch"]: r["count"] for r in files.groupBy("batch").count().collect()}


def run_batches(
    df: DataFrame, key: str, size: int, path: str, fn: Callable[[DataFrame], DataFrame],
    max_batches: int | None = None, per_job: int = BATCHES_PER_JOB,
) -> DataFrame:
    """Process ``df`` in key ranges of about ``size`` rows: one folder ``data/batch=n`` and one state row per batch.

    ``per_job`` batches are written by one job, more where a run would need over ``MAX_JOBS`` jobs: each of them reads
    the table where that is not laid out by the key. A job's rows are numbered in one pass and dealt out by the number,
    so all cores work, and a batch whose key repeats too often is still split over tasks. A job's
    files and then its state rows appear as a whole. A run that broke off goes on after
    the last batch in the state; what a broken job left is overwritten, other batches keep their files. ``fn``
    works on rows and keeps their ``batch`` number. ``key`` is numeric, not null; the bounds of a job
    reach the scan as filters, so on data laid out by the key it reads its own part. Returns the state table.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    bound = lambda value: F.lit(str(value)).cast(kind)
    done = read_state(spark, path).agg(F.max("batch").alias("b"), F.max_by("last_key", "batch").alias("k")).first()
    number, last = (done["b"] or 0), done["k"]
    rest = df if last is None else df.filter(F.col(key) > bound(last))
    bounds = batch_bounds(rest, key, size)[:max_batches]
    per_job = max(per_job, math.ceil(len(bounds) / MAX_JOBS))
    for at in range(0, len(bounds), per_job):
        uppers = bounds[at:at + per_job]
        part = df.filter(F.col(key) <= bound(uppers[-1]))
        if last is not None:
            part = part.filter(F.col(key) > bound(last))
        passed = _below(F.col(key), [bound(u) for u in uppers[:-1]]).cast("long")
        out = fn(part.withColumn("batch", F.lit(number + 1).cast("long") + passed))
        out.hint("rebalance", "batch").write.partitionBy("batch").mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").parquet(f"{path}/data")
        numbers = range(number + 1, number + len(uppers) + 1)
        written = _rows_written(spark, path, numbers)
        state = [(n, str(u), written.get(n, 0), "DONE") for n, u in zip(numbers, uppers, strict=True)]
        spark.createDataFrame(state, STATE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(
            f"{path}/state/from={numbers[0]:08d}")
        number, last = numbers[-1], uppers[-1]
    return read_state(spark, path)


def batch_progress(checkpoints: DataFrame, as_of) -> DataFrame:
    """Minutes running and rows per minute of each process."""
    end = F.coalesce("updated", p.literal(as_of).cast("timestamp_ntz"))
    minutes = date_diff("minute", "start", end)
    return checkpoints.select(
        "process_id", "name", "state", "rows", minutes.alias("minutes"),
        safe_div(F.col("rows").cast("double"), minutes).alias("rows_per_minute"),
    )
