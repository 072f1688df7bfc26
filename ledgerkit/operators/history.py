"""Slowly changing dimensions, versions in time, audit differences, change feeds."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.functions import predicates as p
from ledgerkit.functions.exprs import date_diff
from ledgerkit.operators import ordered
from ledgerkit.operators.merge import assert_unique
from ledgerkit.session import settle

# The open end of a version, and the operation codes of a change feed.
OPEN_END = "9999-12-31 23:59:59.999999"
DELETE, INSERT, BEFORE, AFTER = 1, 2, 3, 4
OPERATIONS = {DELETE: "DELETE", INSERT: "INSERT", BEFORE: "UPDATE BEFORE", AFTER: "UPDATE AFTER"}


def _end(value: str = OPEN_END) -> Column:
    return F.lit(value).cast("timestamp_ntz")


# Slowly changing dimension, type 2

def scd2_apply(
    dim: DataFrame, source: DataFrame, key: str, tracked: Sequence[str], as_of,
) -> tuple[DataFrame, DataFrame]:
    """Close changed rows the day before ``as_of``, open new versions and new keys.

    ``dim`` has ``sk``, the key, the tracked columns, ``start``, ``end`` and ``current``. Returns
    the new dimension and (key, action) with NEW, CHANGE or SAME. Keys missing in the source
    stay as they are; a key that is twice in the source is an error.
    """
    assert_unique(source, [key])
    day = p.literal(as_of).cast("date")
    history, live = dim.filter(~F.col("current")), dim.filter("current")
    incoming = source.select(F.col(key).alias("__key"), *[F.col(c).alias("__" + c) for c in tracked])
    both = live.join(incoming, F.col(key) == F.col("__key"), "full_outer")
    differs = reduce(
        lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col("__" + c)) for c in tracked])
    action = F.when(F.col(key).isNull(), "NEW").when(F.col("__key").isNull(), "ABSENT").when(
        differs, "CHANGE").otherwise("SAME")
    # Read by the numbering, both parts of the dimension and the actions.
    both = settle(both.withColumn("action", action))
    changed = F.col("action") == "CHANGE"
    existing = both.filter(F.col("action") != "NEW").select(
        "sk", key, *tracked, "start",
        F.when(changed, F.date_sub(day, 1)).otherwise(F.col("end")).alias("end"),
        (~changed).alias("current"),
    )
    opened = both.filter(F.col("action").isin("NEW", "CHANGE")).select(
        F.col("__key").alias(key), *[F.col("__" + c).alias(c) for c in tracked])
    top = dim.agg(F.coalesce(F.max("sk"), F.lit(0)).alias("m")).scalar()
    opened = ordered.number_rows(opened, [], [key], "__rn").select(
        (top + F.col("__rn")).alias("sk"), key, *tracked, day.alias("start"),
        F.lit(None).cast("date").alias("end"), F.lit(True).alias("current"),
    )
    actions = both.filter(F.col("action") != "ABSENT").select(F.col("__key").alias(key), "action")
    return history.unionByName(existing).unionByName(opened), actions


# Versions in time, valid from the start up to but not including the end

def versions(changes: DataFrame, keys: Sequence[str], ts: str, seq: str) -> DataFrame:
    """One version per change, valid until the next change of the key."""
    after = ordered.led(changes, keys, [ts, seq], {"valid_to": ts})
    return after.withColumn("valid_to", F.coalesce("valid_to", _end())).withColumnRenamed(
        ts, "valid_from")


def as_of(hist: DataFrame, t) -> DataFrame:
    at = p.literal(t)
    return hist.filter((F.col("valid_from") <= at) & (F.col("valid_to") > at))


def between(hist: DataFrame, a, b) -> DataFrame:
    return hist.filter((F.col("valid_from") <= p.literal(b)) & (F.col("valid_to") > p.literal(a)))


def from_to(hist: DataFrame, a, b) -> DataFrame:
    return hist.filter((F.col("valid_from") < p.literal(b)) & (F.col("valid_to") > p.literal(a)))


def contained_in(hist: DataFrame, a, b) -> DataFrame:
    return hist.filter((F.col("valid_from") >= p.literal(a)) & (F.col("valid_to") <= p.literal(b)))


def version_report(hist: DataFrame, as_of_time, lo=None, hi=None, where: Column | None = None) -> DataFrame:
    """All versions touching a period, with their status and the days they were in force."""
    given = p.when_given
    rows = p.optional_filters(
        hist, where,
        given(lo, lambda v: F.col("valid_to") > p.literal(v)),
        given(hi, lambda v: F.col("valid_from") <= p.literal(v)),
    )
    now = p.literal(as_of_time).cast("timestamp_ntz")
    open_ = F.col("valid_to") == _end()
    until = F.when(open_, now).otherwise(F.col("valid_to"))
    return rows.select(
        "*", F.when(open_, "CURRENT").otherwise("HISTORIC").alias("status"),
        date_diff("day", "valid_from", until).alias("days_in_force"),
    )


def trim_history(hist: DataFrame, years: int, as_of_time) -> DataFrame:
    """Drop versions that ended more than ``years`` years ago."""
    return hist.filter(F.col("valid_to") >= p.literal(p.add_months(as_of_time, -12 * years)))


# Audit rows from two states of a table

def audit_diff(
    before: DataFrame, after: DataFrame, keys: Sequence[str] | None, table: str,
    registry: Mapping[str, Sequence[str]] | None = None, skip_unchanged: bool = True,
) -> DataFrame:
    """One row per inserted, updated or deleted key with both images as JSON.

    Without ``keys`` the key columns come from the registry of the table.
    """
    keys = list(keys or (registry or {})[table])
    old = before.select(*[F.col(k).alias("__o_" + k) for k in keys], F.struct(*before.columns).alias("b"))
    new = after.select(*[F.col(k).alias("__n_" + k) for k in keys], F.struct(*after.columns).alias("a"))
    on = reduce(lambda x, y: x & y, [F.col("__o_" + k) == F.col("__n_" + k) for k in keys])
    both = old.join(new, on, "full_outer")
    op = F.when(F.col("b").isNull(), "I").when(F.col("a").isNull(), "D").otherwise("U")
    rows = both.withColumn("op", op)
    if skip_unchanged:
        rows = rows.filter((F.col("op") != "U") | ~F.col("b").eqNullSafe(F.col("a")))
    key = F.concat_ws("|", *[F.coalesce("__o_" + k, "__n_" + k).cast("string") for k in keys])
    return rows.select(
        "op", F.lit(table).alias("table"), key.alias("key"),
        F.to_json("b").alias("before"), F.to_json("a").alias("after"),
    )


def audit_column(before: DataFrame, after: DataFrame, key: str, col: str) -> DataFrame:
    """Rows whose column changed, with both values, the difference and a JSON record."""
    old = before.select(key, F.col(col).alias("old_value"))
    new = after.select(key, F.col(col).alias("new_value"))
    moved = old.join(new, key).filter(~F.col("old_value").eqNullSafe(F.col("new_value")))
    moved = moved.withColumn("difference", F.col("new_value") - F.col("old_value"))
    record = F.struct("old_value", "new_value", "difference")
    return moved.withColumn("record", F.to_json(record))


def record_history(audit: DataFrame, table: str, keys: str | Sequence[str], ts: str = "ts") -> DataFrame:
    """Changes of one record or several, newest first, with the operation in words."""
    wanted = [keys] if isinstance(keys, str) else list(keys)
    name = F.when(F.col("op") == "I", "Insert").when(F.col("op") == "U", "Update").when(
        F.col("op") == "D", "Delete")
    return audit.filter((F.col("table") == table) & F.col("key").isin(wanted)).withColumn(
        "operation", name).orderBy(F.desc(ts))


def field_changes(audit: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per audited change and field whose value differs between the two images.

    The images are JSON text of any structure: fields may come and go from row to row, nested
    values are compared and given as JSON. An insert gives all its fields as new, a delete as old; a
    field that is missing counts as null. Images are decoded within their row, without a shuffle.
    """
    image = lambda c: F.expr(f"try_cast(try_parse_json(`{c}`) AS MAP<STRING, STRING>)")
    rows = audit.select(*keep, image("before").alias("__b"), image("after").alias("__a"))
    none = F.array().cast("array<string>")
    fields = F.array_union(F.coalesce(F.map_keys("__b"), none), F.coalesce(F.map_keys("__a"), none))
    changed = rows.withColumn("field", F.explode(fields)).withColumns({
        "old_value": F.col("__b")[F.col("field")], "new_value": F.col("__a")[F.col("field")]})
    return changed.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).drop("__b", "__a")


# Change feed: seq, op and the columns of the table

def all_changes(feed: DataFrame, lo: int | Column, hi: int | Column) -> DataFrame:
    """Every change in a range of sequence numbers, operation in words."""
    name = F.lit(None).cast("string")
    for code, text in OPERATIONS.items():
        name = F.when(F.col("op") == code, text).otherwise(name)
    return feed.filter(F.col("seq").between(lo, hi)).withColumn("operation", name)


RELATIONS = ("smallest greater than", "smallest greater than or equal",
             "largest less than", "largest less than or equal")


def seq_at(feed: DataFrame, when, relation: str, ts: str = "ts") -> Column:
    """The sequence number next to a time as a scalar; null when there is none on that side."""
    if relation not in RELATIONS:
        raise ValueError(relation)
    at, time = F.col(ts), p.literal(when)
    equal = relation.endswith("equal")
    if relation.startswith("smallest"):
        return feed.filter(at >= time if equal else at > time).agg(F.min("seq").alias("seq")).scalar()
    return feed.filter(at <= time if equal else at < time).agg(F.max("seq").alias("seq")).scalar()


def changes_between(feed: DataFrame, lo, hi, ts: str = "ts") -> DataFrame:
    """Every change from the first one at or after ``lo`` to the last one at or before ``hi``."""
    return all_changes(
        feed, seq_at(feed, lo, "smallest greater than or equal", ts), seq_at(feed, hi, "largest less than or equal", ts))


def net_changes(feed: DataFrame, keys: Sequence[str], lo: int | None = None, hi: int | None = None) -> DataFrame:
    """One row per key with the effect of all its changes together.

    Inserted and deleted within the range: nothing. Deleted and inserted again: an update.
    First and last change are combined before the shuffle, so a key with very many changes
    reaches its task as one row per map task.
    """
    rows = feed.filter(F.col("op") != BEFORE)
    rows = p.optional_filters(
        rows, p.when_given(lo, lambda v: F.col("seq") >= v), p.when_given(hi, lambda v: F.col("seq") <= v))
    others = [c for c in feed.columns if c not in (*keys, "op")]
    ends = rows.groupBy(*keys).agg(
        F.min_by("op", "seq").alias("first_op"),
        F.max_by(F.struct("op", *others), "seq").alias("l"),
    )
    last = F.col("l.op")
    fresh = F.col("first_op") == INSERT
    net = F.when(fresh & (last != DELETE), INSERT).when(~fresh & (last == DELETE), DELETE).when(
        ~fresh, AFTER)
    return ends.withColumn("op", net).filter(F.col("op").isNotNull()).select(
        "op", *keys, *[F.col("l." + c).alias(c) for c in others])


def apply_changes(table: DataFrame, net: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table after net changes."""
    rest = table.join(net.select(*keys), list(keys), "left_anti")
    return rest.unionByName(net.filter(F.col("op") != DELETE).select(*table.columns))


LOG_SCHEMA = "run long, first_seq long, last_seq long, state string, rows long, noted timestamp_ntz"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LOG_SCHEMA).parquet(path + "/*/*")
    except AnalysisException:
        return spark.createDataFrame([], LOG_SCHEMA)


def consume_changes(
    feed: DataFrame, state_path: str, fn: Callable[[DataFrame, int], None], now: datetime | None = None,
) -> DataFrame:
    """Hand the changes since the last run to ``fn`` (with the run number); returns the log.

    The log has a row for the plan and one for the end of each run, with the number of changes
    and the time (``now``, or the clock's).

    The range is written down before the work, so a run that broke off is repeated over the
    same range under the same number; ``fn`` must overwrite what it wrote for that number.
    """
    spark = feed.sparkSession

    def note(run: int, lo: int, hi: int, state: str, count: int) -> None:
        row = spark.createDataFrame([(run, lo, hi, state, count, now or datetime.now())], LOG_SCHEMA)
        row.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/run={run:08d}/state={state}")

    log = read_log(spark, state_path)
    finished = log.filter("state = 'DONE'")
    open_ = log.filter("state = 'PLANNED'").join(finished.select("run"), "run", "left_anti").first()
    if open_:
        run, lo, hi, count = open_["run"], open_["first_seq"], open_["last_seq"], open_["rows"]
    else:
        seen = finished.agg(F.max("run").alias("r"), F.max("last_seq").alias("s")).first()
        top = feed.agg(F.max("seq")).first()[0]
        if top is None or (seen["s"] is not None and top <= seen["s"]):
            return log
        run = (seen["r"] or 0) + 1
        lo = feed.agg(F.min("seq")).first()[0] if seen["s"] is None else seen["s"] + 1
        hi = top
        count = feed.filter(F.col("seq").between(lo, hi)).count()
        note(run, lo, hi, "PLANNED", count)
    fn(all_changes(feed, lo, hi), run)
    note(run, lo, hi, "DONE", count)
    return read_log(spark, state_path)
