"""Analytics over query logs, event documents, error logs and job runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.functions import predicates as p
from ledgerkit.functions.exprs import clock_seconds, date_diff, percent
from ledgerkit.operators import ordered
from ledgerkit.operators.aggs import avg_last_n, by_period
from ledgerkit.session import settle

# Error numbers that pass by themselves and those that do not.
TRANSIENT = [1205, 1222, -2, 8645]
PERMANENT = [547, 2627, 515, 8152]
# States of a job run.
RUN_STATES = {0: "failed", 1: "succeeded", 2: "retry", 3: "cancelled", 4: "running"}

DOCUMENT = (
    "_name string, _timestamp string, data array<struct<_name string, value string>>, "
    "action array<struct<_name string, value string>>"
)


def _n(name: str = "rows") -> Column:
    return F.count(F.lit(1)).alias(name)


def _mean(col: str) -> Column:
    return F.sum(col).cast("double") / F.count(col)


def slowest(log: DataFrame, n: int, tie: str) -> DataFrame:
    """The ``n`` slowest entries with their place."""
    head = log.orderBy(F.desc("duration"), tie).limit(n)
    return ordered.number_rows(head, [], ["-duration", tie], "place")


def _durations(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(
        _n("calls"), _mean("duration").alias("average"), F.max("duration").alias("longest"),
        F.min("duration").alias("shortest"), F.sum("duration").alias("total"),
    )


def by_object(log: DataFrame) -> DataFrame:
    return _durations(log, "object")


def by_app(log: DataFrame) -> DataFrame:
    return _durations(log, "app")


def by_hour(log: DataFrame) -> DataFrame:
    return _durations(log, F.hour("ts").alias("hour"))


def duration_stats(stats: DataFrame) -> DataFrame:
    """Per query and plan; more than one plan per query hints at an unstable query."""
    return _durations(stats, "query_id", "plan_id")


def session_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session", "name").agg(_n("events"))


def parse_events(df: DataFrame, fields: Mapping[str, tuple[str, str]], xml: str = "xml") -> DataFrame:
    """Columns from event documents. A field is name -> (``data`` or ``action``, SQL type).

    Each document is parsed once; the values are then looked up by name. Text that does not fit
    a type gives null. The parse is a generator of one row, through which Spark pushes no filter: a filter below
    would parse the document again for each of its conditions.
    """
    out = df.select("*", F.explode(F.array(F.from_xml(xml, DOCUMENT))).alias("__e")).select(
        *[c for c in df.columns if c != xml], F.col("__e._name").alias("name"),
        F.try_to_timestamp("__e._timestamp").cast("timestamp_ntz").alias("ts"),
        *[F.map_from_entries(F.coalesce(f"__e.{part}", F.array().cast("array<struct<_name string, value string>>"))).alias("__" + part)
          for part in ("data", "action")],
    )
    value = lambda name, part: F.try_element_at("__" + part, F.lit(name))
    return out.select(
        *[c for c in out.columns if not c.startswith("__")],
        *[value(name, part).try_cast(kind).alias(name) for name, (part, kind) in fields.items()],
    )


def by_hash(parsed: DataFrame, hash_col: str, value: str) -> DataFrame:
    return parsed.groupBy(hash_col).agg(
        _n("executions"), _mean(value).alias("average"), F.max(value).alias("longest"), F.sum(value).alias("total"))


def recent(parsed: DataFrame, name: str, hours: int, as_of) -> DataFrame:
    """Events of one kind in the last hours, newest first.

    The found rows are settled, since sorting samples its input first and that would parse all documents twice.
    """
    rows = parsed.filter((F.col("name") == name) & p.last("ts", hours, "hour", as_of))
    return settle(rows).orderBy(F.desc("ts"))


def error_stats(log: DataFrame):
    """Errors by number, by hour and by procedure; without one they count as ad hoc."""
    by_number = log.groupBy("number").agg(
        _n("errors"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    procedure = F.coalesce("procedure", F.lit("Ad-hoc")).alias("procedure")
    by_procedure = log.groupBy(procedure).agg(_n("errors"), F.count_distinct("number").alias("numbers"))
    return by_number, by_period(log, "ts", "hour", _n("errors")), by_procedure


def classify_errors(log: DataFrame) -> DataFrame:
    """Transient (worth another try) or permanent, and the band of the severity."""
    kind = F.when(F.col("number").isin(TRANSIENT), "transient").when(
        F.col("number").isin(PERMANENT), "permanent").otherwise("other")
    band = F.when(F.col("severity") <= 10, "information").when(
        F.col("severity") <= 16, "user").when(F.col("severity") <= 19, "resource").otherwise("fatal")
    return log.withColumns({"kind": kind, "band": band})


def run_state(col: str = "status") -> Column:
    out = F.lit("unknown")
    for code, text in RUN_STATES.items():
        out = F.when(F.col(col) == code, text).otherwise(out)
    return out


def run_history(runs: DataFrame, as_of, name: str | None = None, state: int | None = None, days: int = 7) -> DataFrame:
    """Job outcomes (step 0) with the run time in seconds; filters are optional."""
    given = p.when_given
    rows = p.optional_filters(
        runs.filter(F.col("step_id") == 0), p.last("run_ts", days, "day", as_of),
        given(name, lambda v: F.col("job") == v), given(state, lambda v: F.col("status") == v))
    return rows.withColumns({"result": run_state(), "seconds": clock_seconds("duration_hhmmss")})


def failures(runs: DataFrame, as_of, hours: int = 24) -> DataFrame:
    failed = runs.filter((F.col("status") == 0) & p.last("run_ts", hours, "hour", as_of))
    return failed.groupBy("job").agg(_n("failures"), F.max("run_ts").alias("last_failure"))


def running(runs: DataFrame, as_of) -> DataFrame:
    now = p.literal(as_of).cast("timestamp_ntz")
    return runs.filter(F.col("status") == 4).select(
        "job", "run_ts", date_diff("minute", "run_ts", now).alias("minutes"))


def run_dashboard(runs: DataFrame, schedule: DataFrame, as_of, tie: Sequence[str] = ("run_id",)) -> DataFrame:
    """Per job: last run and result, next run, mean of the last five, success share of a month."""
    outcomes = runs.filter(F.col("step_id") == 0).withColumn("seconds", clock_seconds("duration_hhmmss"))
    last = ordered.latest(outcomes.select("job", "run_ts", "status", *tie), ["job"], ["run_ts", *tie])
    last = last.select("job", F.col("run_ts").alias("last_run"), run_state().alias("last_result"))
    five = avg_last_n(outcomes, ["job"], ["run_ts", *tie], "seconds", 5)
    month = outcomes.filter(p.last("run_ts", 1, "month", as_of)).groupBy("job").agg(
        percent(F.count_if(F.col("status") == 1), F.count(F.lit(1))).alias("success_pct"))
    ahead = schedule.filter(F.col("next_run") > p.literal(as_of)).groupBy("job").agg(
        F.min("next_run").alias("next_run"))
    out = last.join(five.select("job", F.col("average").alias("average_seconds")), "job", "left")
    return out.join(month, "job", "left").join(ahead, "job", "left")
