"""Fraud rules, audit reports and retention.

A log has ``account_id``, ``ts``, ``amount`` and ``kind``; an audit table has ``table``, ``user``,
``op`` (I, U, D) and ``ts``. Statistics are combined before the shuffle and joined back to the
recent rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.functions import predicates as p
from ledgerkit.functions.exprs import date_diff, day_name, money
from ledgerkit.operators import ordered
from ledgerkit.operators.aggs import by_period, ordered_items
from ledgerkit.operators.merge import archive_older, delete_where
from ledgerkit.operators.paging import order_by_label

SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
OPERATIONS = {"I": "INSERT", "U": "UPDATE", "D": "DELETE"}


def amount_stats(df: DataFrame, key: str, min_rows: int = 10) -> DataFrame:
    """Mean and sample deviation per key with enough rows."""
    value = F.col("amount").cast("double")
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"),
        F.count(F.lit(1)).alias("history"),
    ).filter(F.col("history") >= min_rows)


def zscore_outliers(
    tx: DataFrame, key: str, days: int, k: float, as_of, recent_days: int = 1, min_rows: int = 10,
    history: Column | None = None,
) -> DataFrame:
    """Recent rows more than ``k`` deviations from the mean of their key, with a label."""
    past = p.last("ts", days, "day", as_of)
    stats = amount_stats(tx.filter(past if history is None else past & history), key, min_rows)
    recent = tx.filter(p.last("ts", recent_days, "day", as_of))
    z = F.try_divide(F.col("amount").cast("double") - F.col("mean"), F.nullif("deviation", F.lit(0.0)))
    rows = recent.join(stats, key).withColumn("z", z).filter(F.abs("z") > k)
    label = F.when(F.col("z") > k, "ABNORMALLY HIGH").otherwise("ABNORMALLY LOW")
    return rows.withColumn("label", label).orderBy(F.desc(F.abs("z")))


def amount_alerts(log: DataFrame, as_of, k: float = 3.0, months: int = 3) -> DataFrame:
    """Amounts of the last day above mean + k deviations of the account's last months."""
    stats = amount_stats(log.filter(p.last("ts", months, "month", as_of)), "account_id")
    recent = log.filter(p.last("ts", 1, "day", as_of)).join(stats, "account_id")
    return recent.filter(F.col("amount").cast("double") > F.col("mean") + k * F.col("deviation"))


def frequency_alerts(log: DataFrame, as_of, minutes: int = 5, n: int = 3) -> DataFrame:
    recent = log.filter(p.last("ts", minutes, "minute", as_of))
    counted = recent.groupBy("account_id").agg(F.count(F.lit(1)).alias("operations"))
    return counted.filter(F.col("operations") >= n)


def outside(ts: str, opens: int, closes: int) -> Column:
    """Before the opening hour or from the closing hour on."""
    return (F.hour(ts) < opens) | (F.hour(ts) >= closes)


def off_hours(log: DataFrame, opens: int = 6, closes: int = 22) -> DataFrame:
    return log.filter(outside("ts", opens, closes))


def impossible_travel(
    log: DataFrame, key: str = "account_id", place: str = "place", minutes: int = 30,
    tie: Sequence[str] = ("event_id",),
) -> DataFrame:
    """Rows in another place than the row before, within fewer than ``minutes`` minutes."""
    rows = ordered.lagged(log, [key], ["ts", *tie], {"previous_place": place, "previous_ts": "ts"})
    gap = date_diff("minute", "previous_ts", "ts")
    moved = (F.col(place) != F.col("previous_place")) & (gap < minutes)
    return rows.filter(moved).withColumn("seconds", date_diff("second", "previous_ts", "ts"))


def first_seen(log: DataFrame, key: str, device: str) -> DataFrame:
    """First use of each device per key; ``is_new`` for all but the key's very first device."""
    first = log.groupBy(key, device).agg(F.min("ts").alias("first_ts"))
    start = first.groupBy(key).agg(F.min("first_ts").alias("key_start"))
    rows = first.join(start, key)
    return rows.withColumn("is_new", F.col("first_ts") > F.col("key_start")).drop("key_start")


def sudden_change(log: DataFrame, key: str, column: str, tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """Rows whose column (address, country) differs from the row before."""
    rows = ordered.lagged(log, [key], ["ts", *tie], {"previous": column})
    return rows.filter(F.col(column) != F.col("previous"))


def alerts(
    log: DataFrame, as_of, minutes: int = 5, n: int = 3, k: float = 3.0, place: str = "place",
    travel_hours: int = 1,
) -> DataFrame:
    """Alerts of all rules in one table, most severe first."""
    day = p.last("ts", 1, "day", as_of)

    def rule(df: DataFrame, name: str, severity: str, text: Column) -> DataFrame:
        return df.select("account_id", F.lit(name).alias("alert"), text.alias("description"), F.lit(severity).alias("severity"))

    often = rule(
        frequency_alerts(log, as_of, minutes, n), "HIGH_FREQUENCY", "HIGH",
        F.concat(F.col("operations").cast("string"), F.lit(f" operations in {minutes} minutes")))
    large = rule(
        amount_alerts(log, as_of, k), "UNUSUAL_AMOUNT", "MEDIUM",
        F.concat(money("amount"), F.lit(f" exceeds {k:g} deviations")))
    late = rule(
        off_hours(log.filter(day)), "OFF_HOURS", "LOW",
        F.concat(money("amount"), F.lit(" at "), F.date_format("ts", "HH:mm:ss")))
    travel = rule(
        impossible_travel(log.filter(p.last("ts", travel_hours, "hour", as_of)), place=place),
        "IMPOSSIBLE_TRAVEL", "CRITICAL",
        F.concat(F.col(place), F.lit(" "), F.col("seconds").cast("string"), F.lit(" seconds after "), F.col("previous_place")))
    out = often.unionByName(large).unionByName(late).unionByName(travel)
    return order_by_label(out, "severity", SEVERITIES, "alert", "account_id")


def _op(code: str, name: str) -> Column:
    return F.count_if(F.col("op") == code).alias(name)


def _n(name: str = "operations") -> Column:
    return F.count(F.lit(1)).alias(name)


def audit_dashboard(audit: DataFrame, days: int, as_of):
    """Activity by table, by user, by hour of the day and by day."""
    rows = audit.filter(p.last("ts", days, "day", as_of))
    by_table = rows.groupBy("table").agg(
        _op("I", "inserts"), _op("U", "updates"), _op("D", "deletes"), _n())
    by_user = rows.groupBy("user").agg(
        _n(), F.count_distinct("table").alias("tables"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return by_table, by_user, by_period(rows, "ts", "hour", _n()), by_period(rows, "ts", "day", _n())


def suspicious(audit: DataFrame, as_of, bound: int = 100, hours: int = 24, deletes: int = 10):
    """Users with too many operations, work at night, mass deletions."""
    rows = audit.filter(p.last("ts", hours, "hour", as_of))
    busy = rows.groupBy("user").agg(_n(), F.count_distinct("table").alias("tables")).filter(
        F.col("operations") > bound)
    mass = rows.filter(F.col("op") == "D").groupBy("user", "table").agg(
        _n("deletes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return busy, off_hours(rows), mass.filter(F.col("deletes") > deletes)


def compliance_report(audit: DataFrame, lo, hi, top: int = 10):
    """By operation, top users, off-hours per user, the off-hours one by one, by weekday, retention."""
    rows = audit.filter(p.between_days("ts", lo, hi))
    word = F.lit(None).cast("string")
    for code, text in OPERATIONS.items():
        word = F.when(F.col("op") == code, text).otherwise(word)
    by_op = rows.groupBy(word.alias("operation")).agg(
        _n(), F.count_distinct("user").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    users = rows.groupBy("user").agg(_n(), _op("I", "inserts"), _op("U", "updates"), _op("D", "deletes"))
    users = users.orderBy(F.desc("operations"), "user").limit(top)
    late = rows.filter(outside("ts", 8, 18)).withColumn("time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    times = ordered_items(late, ["user"], "time")
    night = late.groupBy("user").agg(_n())
    weekday = rows.groupBy(F.dayofweek("ts").alias("weekday"), day_name("ts").alias("day_name")).agg(_n())
    ends = audit.agg(_n("records"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    return by_op, users, night, times, weekday, ends.withColumn("days", date_diff("day", "oldest", "newest"))


def large_count(tx: DataFrame, day, bound: float) -> DataFrame:
    """Number and sum of transactions over a bound on a day."""
    rows = tx.filter(p.on_day("ts", day) & (F.col("amount") > bound))
    return rows.agg(_n("transactions"), F.sum("amount").alias("amount"))


# Retention

def purge_audit(audit: DataFrame, days: int, as_of, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, one log row with the number of old rows). A dry run removes nothing."""
    kept, old = delete_where(audit, p.older_than("ts", days, "day", as_of))
    log = old.agg(_n("rows")).select(
        F.lit("DRY RUN" if dry_run else "PURGE").alias("action"), "rows",
        p.literal(p.shift(as_of, -days, "day")).cast("timestamp_ntz").alias("cutoff"))
    return (audit if dry_run else kept), log


def retain_audit(
    audit: DataFrame, archive: DataFrame, keys: Sequence[str], days: int, as_of, dry_run: bool = True,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to archive, rows that stay, statistics)."""
    fresh, kept = archive_older(audit, archive, keys, "ts", p.shift(as_of, -days, "day"))
    old = F.coalesce(F.col("ts") < p.literal(p.shift(as_of, -days, "day")), F.lit(False))
    both = audit.agg(_n("total"), F.count_if(~old).alias("kept")).unpivot([], ["total", "kept"], "stage", "rows")
    stats = both.unionByName(fresh.agg(_n("archived")).unpivot([], ["archived"], "stage", "rows"))
    if dry_run:
        return fresh.limit(0), audit, stats
    return fresh, kept, stats


def purge_table(df: DataFrame, ts: str, days: int, as_of, count_only: bool = False) -> DataFrame:
    """Rows younger than ``days`` days, or the count of the others. The column must be a date type."""
    if ts not in df.columns:
        raise ValueError(f"no column {ts!r}")
    if not isinstance(df.schema[ts].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise TypeError(f"{ts!r} is not a date")
    kept, old = delete_where(df, p.older_than(ts, days, "day", as_of))
    return old.agg(_n("rows")) if count_only else kept
