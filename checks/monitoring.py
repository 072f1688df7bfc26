"""Fraud rules, audit reports, log analytics and stream forms."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from checks.basics import TX_COLS
from checks.common import in_order, on_bank, on_tables
from checks.reports import STAR
from ledgerkit.plans import fraud, logs
from ledgerkit.session import checkpoint_dir
from ledgerkit.sources import bank as views
from ledgerkit.sources.readers import load
from ledgerkit.streaming import buckets, monitors

NOW = "2024-01-25 12:00:00"
LAST = "2024-01-30 00:00:00"


def log(spark, folder):
    return views.activity(spark, folder).drop("props").withColumnRenamed("kind", "place")


LOG = """log AS (SELECT event_id, user_id AS account_id, ts, event_type AS place, CAST(value AS DECIMAL(18,2)) AS amount FROM events)"""
LOG_COLS = "event_id, account_id, ts, place, CAST(log.amount AS DOUBLE) AS amount"


def audit(spark, folder):
    e = F.col("event_id")
    return load(spark, folder, "events").select(
        "event_id", F.concat(F.lit("T"), F.col("user_id") % 4).alias("table"), F.col("user_id").alias("user"),
        F.when(e % 3 == 0, "I").when(e % 3 == 1, "U").otherwise("D").alias("op"), "ts")


AUDIT = """audit AS (SELECT event_id, 'T' || user_id % 4 AS "table", user_id AS "user", ['I', 'U', 'D'][event_id % 3 + 1] AS op, ts FROM events)"""
_OPS = "count(*) FILTER (op = 'I') AS inserts, count(*) FILTER (op = 'U') AS updates, count(*) FILTER (op = 'D') AS deletes"
_WEEK = "ts >= TIMESTAMP '2024-01-18 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'"
_DAY = "ts >= TIMESTAMP '2024-01-24 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'"
_PERIOD = "ts >= DATE '2024-01-05' AND ts < DATE '2024-01-21'"


def query_log(spark, folder):
    e = load(spark, folder, "events")
    return e.select(
        "event_id", "ts", F.concat(F.lit("proc_"), F.col("user_id") % 20).alias("object"), F.col("event_type").alias("app"),
        F.col("value").cast("decimal(18,2)").alias("duration"), (F.col("user_id") % 7).alias("query_id"), (F.col("event_id") % 3).alias("plan_id"),
        F.concat(F.lit("session_"), F.col("user_id") % 5).alias("session"), F.col("event_type").alias("name"))


QLOG = """q AS (SELECT event_id, ts, 'proc_' || user_id % 20 AS object, event_type AS app, CAST(value AS DECIMAL(18,2)) AS duration,
 user_id % 7 AS query_id, event_id % 3 AS plan_id, 'session_' || user_id % 5 AS session, event_type AS name FROM events)"""
_DUR = """count(*) AS calls, round(CAST(sum(duration) AS DOUBLE) / count(*), 4) AS average, CAST(max(duration) AS DOUBLE) AS longest,
 CAST(min(duration) AS DOUBLE) AS shortest, CAST(sum(duration) AS DOUBLE) AS total"""


def documents(spark, folder):
    """The events written out as event documents."""
    e = load(spark, folder, "events")
    item = lambda tag, name, value: F.concat(F.lit(f'<{tag} name="{name}"><value>'), value.cast("string"), F.lit(f"</value></{tag}>"))
    return e.select("event_id", F.concat(
        F.lit('<event name="'), F.col("event_type"), F.lit('" timestamp="'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('">'),
        item("data", "duration", F.col("value").cast("decimal(18,2)")), item("data", "reads", F.col("event_id") % 100),
        item("action", "query_hash", F.col("user_id") % 7), item("action", "login", F.concat(F.lit("u"), "user_id")), F.lit("</event>")).alias("xml"))


EVENT_FIELDS = {"duration": ("data", "decimal(18,2)"), "reads": ("data", "bigint"), "query_hash": ("action", "bigint"), "login": ("action", "string")}


def parsed(spark, folder):
    return logs.parse_events(documents(spark, folder), EVENT_FIELDS)


PARSED = """pe AS (SELECT event_id, event_type AS name, ts, CAST(value AS DECIMAL(18,2)) AS duration, event_id % 100 AS reads, user_id % 7 AS query_hash,
 'u' || user_id AS login FROM events)"""


def error_log(spark, folder):
    codes = F.array(*[F.lit(c) for c in (*logs.TRANSIENT, *logs.PERMANENT, 50000)])
    return load(spark, folder, "events").select(
        "event_id", "ts", F.element_at(codes, (F.col("event_id") % 9 + 1).cast("int")).alias("number"), (F.col("user_id") % 25).alias("severity"),
        F.when(F.col("user_id") % 6 > 0, F.concat(F.lit("sp_"), F.col("user_id") % 6)).alias("procedure"))


ELOG = """el AS (SELECT event_id, ts, [1205, 1222, -2, 8645, 547, 2627, 515, 8152, 50000][event_id % 9 + 1] AS number, user_id % 25 AS severity,
 CASE WHEN user_id % 6 > 0 THEN 'sp_' || user_id % 6 END AS procedure FROM events)"""


def runs(spark, folder):
    e = F.col("event_id")
    return load(spark, folder, "events").select(
        e.alias("run_id"), F.concat(F.lit("job_"), F.col("user_id") % 10).alias("job"), (e % 3).alias("step_id"), (F.col("user_id") * 7 + e).alias("x"),
        F.col("ts").alias("run_ts")).select(
            "run_id", "job", "step_id", (F.col("x") % 5).alias("status"), "run_ts",
            ((F.col("x") % 3) * 10000 + (F.col("x") % 60) * 100 + F.col("x") % 60).alias("duration_hhmmss"))


def schedule(spark, folder):
    return load(spark, folder, "events").select(
        F.concat(F.lit("job_"), F.col("user_id") % 10).alias("job"), F.col("ts").alias("next_run"))


RUNS = """runs AS (SELECT event_id AS run_id, 'job_' || user_id % 10 AS job, event_id % 3 AS step_id, (user_id * 7 + event_id) % 5 AS status, ts AS run_ts,
 ((user_id * 7 + event_id) % 3) * 10000 + ((user_id * 7 + event_id) % 60) * 100 + (user_id * 7 + event_id) % 60 AS duration_hhmmss,
 ((user_id * 7 + event_id) % 3) * 3600 + ((user_id * 7 + event_id) % 60) * 61 AS seconds FROM events)"""
_RESULT = "['failed', 'succeeded', 'retry', 'cancelled', 'running'][status + 1]"


# Streams: the event file as a stream, results read back as a table

def stream(spark, folder):
    schema = load(spark, folder, "events").schema
    # As a pattern, because a stream takes a bare path for a folder.
    return monitors.read_files(spark, f"{folder}/events*.parquet", schema).select(
        "event_id", F.col("user_id").alias("account_id"), "ts", F.col("event_type").alias("place"), F.col("value").cast("decimal(18,2)").alias("amount"))


def work(spark):
    return f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def finished(query):
    query.awaitTermination()
    return query


def zoneless(df):
    return df.withColumns({f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if f.dataType.simpleString() == "timestamp"})


def streamed(build):
    """Run a streaming frame into files and read them."""
    def run(spark, folder):
        path = work(spark)
        out = build(stream(spark, folder))
        finished(monitors.to_files(out, path + "/out", path + "/checkpoint"))
        return zoneless(spark.read.schema(out.schema).parquet(path + "/out"))
    return on_tables(run)


def slow_stream(spark, folder):
    path = work(spark)
    out = stream(spark, folder).withColumnRenamed("amount", "duration")
    finished(monitors.slow_monitor(out, 20, path + "/out", path + "/checkpoint"))
    return zoneless(spark.read.schema(out.schema).parquet(path + "/out"))


def travel(spark, folder):
    """Three batches; the last brings a tenth of the rows late, some from the start of the feed."""
    path, events = work(spark), load(spark, folder, "events")
    middle = events.select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    late, first = F.col("event_id") % 10 == 3, F.unix_micros(F.col("ts").cast("timestamp")) <= F.lit(middle)
    # The stream runs once per write, so each write is one batch whatever its number of files.
    for part in (~late & first, ~late & ~first, late):
        events.filter(part).write.mode("append").parquet(path + "/feed")
        feed = monitors.read_files(spark, path + "/feed", events.schema).select(
            "event_id", F.col("user_id").alias("account_id"), "ts", F.col("event_type").alias("place"))
        finished(monitors.travel_stream(feed, path, path + "/checkpoint", lateness=timedelta(days=365)))
    return zoneless(monitors.travel_alerts(spark, path).drop("previous_ts"))


def cdc(spark, folder):
    """The feed in three batches, in the order of its numbers."""
    path, events, e = work(spark), load(spark, folder, "events"), F.col("event_id")
    cuts = events.select(F.percentile_approx("event_id", [0.33, 0.66])).first()[0]
    for part in (e <= cuts[0], (e > cuts[0]) & (e <= cuts[1]), e > cuts[1]):
        events.filter(part).write.mode("append").parquet(path + "/feed")
        feed = monitors.read_files(spark, path + "/feed", events.schema).select(
            e.alias("seq"), F.when(e % 11 < 2, 2).when(e % 11 == 2, 1).when(e % 11 == 3, 3).otherwise(4).alias("op"),
            (F.col("user_id") * 100 + e % 17).alias("key"), F.col("event_type").alias("kind"),
            F.col("value").cast("decimal(18,2)").alias("amount"))
        finished(monitors.cdc_stream(feed, path + "/table", path + "/checkpoint", ["key"], ["key", "kind", "amount"], 8))
    return buckets.read(spark, path + "/table", feed.select("key", "kind", "amount").schema, ["key"])


QUERIES = {
    "zscore": on_tables(lambda s, d: in_order(
        fraud.zscore_outliers(log(s, d), "account_id", 90, 2.5, LAST, recent_days=10).withColumn("size", F.abs("z")), "size").drop("size")),
    "amount_alerts": on_tables(lambda s, d: fraud.amount_alerts(log(s, d), LAST, 2.0)),
    "frequency": on_tables(lambda s, d: fraud.frequency_alerts(log(s, d), NOW, 720, 2)),
    "off_hours": on_tables(lambda s, d: fraud.off_hours(log(s, d))),
    "travel": on_tables(lambda s, d: fraud.impossible_travel(log(s, d), minutes=240)),
    "first_seen": on_tables(lambda s, d: fraud.first_seen(log(s, d), "account_id", "place")),
    "sudden_change": on_tables(lambda s, d: fraud.sudden_change(log(s, d), "account_id", "place")),
    "alerts": on_tables(lambda s, d: in_order(
        fraud.alerts(log(s, d), NOW, minutes=1440, n=3, k=2.0, travel_hours=240), "severity", "alert", "account_id")),
    "audit_by_table": on_tables(lambda s, d: fraud.audit_dashboard(audit(s, d), 7, NOW)[0]),
    "audit_by_user": on_tables(lambda s, d: fraud.audit_dashboard(audit(s, d), 7, NOW)[1]),
    "audit_by_hour": on_tables(lambda s, d: fraud.audit_dashboard(audit(s, d), 7, NOW)[2]),
    "audit_by_day": on_tables(lambda s, d: fraud.audit_dashboard(audit(s, d), 7, NOW)[3]),
    "suspicious_users": on_tables(lambda s, d: fraud.suspicious(audit(s, d), NOW, 3, 24)[0]),
    "suspicious_nights": on_tables(lambda s, d: fraud.suspicious(audit(s, d), NOW, 3, 24)[1]),
    "suspicious_deletes": on_tables(lambda s, d: fraud.suspicious(audit(s, d), NOW, 3, 240, 3)[2]),
    "compliance_ops": on_tables(lambda s, d: fraud.compliance_report(audit(s, d), "2024-01-05", "2024-01-20")[0]),
    "compliance_users": on_tables(lambda s, d: fraud.compliance_report(audit(s, d), "2024-01-05", "2024-01-20")[1]),
    "compliance_nights": on_tables(lambda s, d: fraud.compliance_report(audit(s, d), "2024-01-05", "2024-01-20")[2]),
    "compliance_night_times": on_tables(lambda s, d: fraud.compliance_report(audit(s, d), "2024-01-05", "2024-01-20")[3]),
    "compliance_weekdays": on_tables(lambda s, d: fraud.compliance_report(audit(s, d), "2024-01-05", "2024-01-20")[4]),
    "compliance_retention": on_tables(lambda s, d: fraud.compliance_report(audit(s, d), "2024-01-05", "2024-01-20")[5]),
    "large_count": on_bank(lambda b: fraud.large_count(b.tx, "1998-03-02", 30000)),
    "purge": on_tables(lambda s, d: fraud.purge_table(load(s, d, "events"), "ts", 10, NOW)),
    "purge_count": on_tables(lambda s, d: fraud.purge_table(load(s, d, "events"), "ts", 10, NOW, count_only=True)),
    "purge_audit": on_tables(lambda s, d: fraud.purge_audit(audit(s, d), 10, NOW, dry_run=False)[1]),
    "purge_audit_rows": on_tables(lambda s, d: fraud.purge_audit(audit(s, d), 10, NOW, dry_run=False)[0]),
    "retain_archived": on_tables(lambda s, d: fraud.retain_audit(
        audit(s, d), audit(s, d).filter("ts < '2024-01-03'"), ["event_id"], 10, NOW, dry_run=False)[0]),
    "retain_audit": on_tables(lambda s, d: fraud.retain_audit(
        audit(s, d), audit(s, d).filter("ts < '2024-01-03'"), ["event_id"], 10, NOW, dry_run=False)[2]),
    "slowest": on_tables(lambda s, d: logs.slowest(query_log(s, d), 25, "event_id")),
    "by_object": on_tables(lambda s, d: logs.by_object(query_log(s, d))),
    "by_app": on_tables(lambda s, d: logs.by_app(query_log(s, d))),
    "by_hour": on_tables(lambda s, d: logs.by_hour(query_log(s, d))),
    "duration_stats": on_tables(lambda s, d: logs.duration_stats(query_log(s, d))),
    "session_counts": on_tables(lambda s, d: logs.session_counts(query_log(s, d))),
    "parse_events": on_tables(parsed),
    "by_hash": on_tables(lambda s, d: logs.by_hash(parsed(s, d), "query_hash", "duration")),
    "recent_errors": on_tables(lambda s, d: in_order(logs.recent(parsed(s, d), "error", 48, NOW), "ts")),
    "errors_by_number": on_tables(lambda s, d: logs.error_stats(error_log(s, d))[0]),
    "errors_by_hour": on_tables(lambda s, d: logs.error_stats(error_log(s, d))[1]),
    "errors_by_procedure": on_tables(lambda s, d: logs.error_stats(error_log(s, d))[2]),
    "classify_errors": on_tables(lambda s, d: logs.classify_errors(error_log(s, d))),
    "run_history": on_tables(lambda s, d: logs.run_history(runs(s, d), NOW, state=1, days=7)),
    "run_failures": on_tables(lambda s, d: logs.failures(runs(s, d), NOW)),
    "running": on_tables(lambda s, d: logs.running(runs(s, d), LAST)),
    "run_dashboard": on_tables(lambda s, d: logs.run_dashboard(runs(s, d).filter(f"run_ts <= '{NOW}'"), schedule(s, d), NOW)),
    "slow_stream": on_tables(slow_stream),
    "frequency_stream": streamed(lambda st: monitors.frequency_stream(st, "6 hours", None, "10 minutes", 2)),
    "frequency_sliding": streamed(lambda st: monitors.frequency_stream(st, "6 hours", "3 hours", "10 minutes", 3)),
    "activity_stream": streamed(lambda st: monitors.activity_stream(st, "1 hour", "10 minutes", ["place"])),
    "session_stream": streamed(lambda st: monitors.session_stream(st, "2 hours", "10 minutes")),
    "travel_stream": on_tables(travel),
    "cdc_stream": on_tables(cdc),
}

_LAGGED = f"""WITH {LOG}, lg AS (SELECT *, lag(place) OVER w AS previous_place, lag(ts) OVER w AS previous_ts FROM log
 WINDOW w AS (PARTITION BY account_id ORDER BY ts, event_id))"""
_STATS = """avg(CAST(amount AS DOUBLE)) AS mean, stddev_samp(CAST(amount AS DOUBLE)) AS deviation, count(*) AS history"""
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM log)"

SQL = {
    "zscore": f"""WITH {LOG}, st AS (SELECT account_id, {_STATS} FROM log WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 90 DAY
 AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1 HAVING count(*) >= 10), z AS (SELECT log.*, mean, deviation, history,
 (CAST(log.amount AS DOUBLE) - mean) / nullif(deviation, 0) AS z FROM log JOIN st USING (account_id)
 WHERE ts >= TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-30')
 SELECT event_id, account_id, ts, place, CAST(z.amount AS DOUBLE) AS amount, round(mean, 4) AS mean, round(deviation, 4) AS deviation, history, round(z.z, 4) AS z,
 rank() OVER (ORDER BY abs(z.z) DESC) AS position, CASE WHEN z.z > 2.5 THEN 'ABNORMALLY HIGH' ELSE 'ABNORMALLY LOW' END AS label FROM z WHERE abs(z.z) > 2.5""",
    "amount_alerts": f"""WITH {LOG}, st AS (SELECT account_id, {_STATS} FROM log WHERE ts >= TIMESTAMP '2023-10-30'
 AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1 HAVING count(*) >= 10)
 SELECT {LOG_COLS}, round(mean, 4) AS mean, round(deviation, 4) AS deviation, history FROM log JOIN st USING (account_id)
 WHERE ts >= TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30' AND CAST(log.amount AS DOUBLE) > mean + 2.0 * deviation""",
    "frequency": f"""WITH {LOG} SELECT account_id, count(*) AS operations FROM log WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'
 AND ts <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY 1 HAVING count(*) >= 2""",
    "off_hours": f"WITH {LOG} SELECT {LOG_COLS} FROM log WHERE hour(ts) < 6 OR hour(ts) >= 22",
    "travel": f"""{_LAGGED} SELECT event_id, account_id, ts, place, CAST(lg.amount AS DOUBLE) AS amount, previous_place, previous_ts,
 date_diff('second', previous_ts, ts) AS seconds FROM lg WHERE place <> previous_place AND date_diff('minute', previous_ts, ts) < 240""",
    "first_seen": f"""WITH {LOG} SELECT account_id, place, min(ts) AS first_ts, min(ts) > min(min(ts)) OVER (PARTITION BY account_id) AS is_new FROM log GROUP BY 1, 2""",
    "sudden_change": f"""{_LAGGED} SELECT event_id, account_id, ts, place, CAST(lg.amount AS DOUBLE) AS amount, previous_place AS previous FROM lg WHERE place <> previous_place""",
    "alerts": f"""WITH {LOG}, st AS (SELECT account_id, {_STATS} FROM log WHERE ts >= TIMESTAMP '2023-10-25 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'
  GROUP BY 1 HAVING count(*) >= 10),
 lg AS (SELECT *, lag(place) OVER w AS pp, lag(ts) OVER w AS pt FROM log WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'
  WINDOW w AS (PARTITION BY account_id ORDER BY ts, event_id)), al AS (
 SELECT account_id, 'HIGH_FREQUENCY' AS alert, count(*) || ' operations in 1440 minutes' AS description, 'HIGH' AS severity FROM log WHERE {_DAY} GROUP BY 1 HAVING count(*) >= 3
 UNION ALL SELECT account_id, 'UNUSUAL_AMOUNT', '$' || format('{{:,.2f}}', CAST(amount AS DOUBLE)) || ' exceeds 2 deviations', 'MEDIUM' FROM log JOIN st USING (account_id)
 WHERE {_DAY} AND CAST(amount AS DOUBLE) > mean + 2.0 * deviation
 UNION ALL SELECT account_id, 'OFF_HOURS', '$' || format('{{:,.2f}}', CAST(amount AS DOUBLE)) || ' at ' || strftime(ts, '%H:%M:%S'), 'LOW' FROM log
 WHERE {_DAY} AND (hour(ts) < 6 OR hour(ts) >= 22)
 UNION ALL SELECT account_id, 'IMPOSSIBLE_TRAVEL', place || ' ' || date_diff('second', pt, ts) || ' seconds after ' || pp, 'CRITICAL' FROM lg
 WHERE place <> pp AND date_diff('minute', pt, ts) < 30)
 SELECT *, rank() OVER (ORDER BY list_position(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], severity), alert, account_id) AS position FROM al""",
    "audit_by_table": f"""WITH {AUDIT} SELECT "table", {_OPS}, count(*) AS operations FROM audit WHERE {_WEEK} GROUP BY 1""",
    "audit_by_user": f"""WITH {AUDIT} SELECT "user", count(*) AS operations, count(DISTINCT "table") AS tables, min(ts) AS first_ts, max(ts) AS last_ts FROM audit WHERE {_WEEK} GROUP BY 1""",
    "audit_by_hour": f"WITH {AUDIT} SELECT hour(ts) AS hour, count(*) AS operations FROM audit WHERE {_WEEK} GROUP BY 1",
    "audit_by_day": f"WITH {AUDIT} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS operations FROM audit WHERE {_WEEK} GROUP BY 1",
    "suspicious_users": f"""WITH {AUDIT} SELECT "user", count(*) AS operations, count(DISTINCT "table") AS tables FROM audit WHERE {_DAY} GROUP BY 1 HAVING count(*) > 3""",
    "suspicious_nights": f"""WITH {AUDIT} SELECT event_id, "table", "user", op, ts FROM audit WHERE {_DAY} AND (hour(ts) < 6 OR hour(ts) >= 22)""",
    "suspicious_deletes": f"""WITH {AUDIT} SELECT "user", "table", count(*) AS deletes, min(ts) AS first_ts, max(ts) AS last_ts FROM audit
 WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00' AND op = 'D' GROUP BY 1, 2 HAVING count(*) > 3""",
    "compliance_ops": f"""WITH {AUDIT} SELECT CASE op WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END AS operation, count(*) AS operations,
 count(DISTINCT "user") AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM audit WHERE {_PERIOD} GROUP BY 1""",
    "compliance_users": f"""WITH {AUDIT} SELECT "user", count(*) AS operations, {_OPS} FROM audit WHERE {_PERIOD} GROUP BY 1 ORDER BY operations DESC, "user" LIMIT 10""",
    "compliance_nights": f"""WITH {AUDIT} SELECT "user", count(*) AS operations FROM audit WHERE {_PERIOD} AND (hour(ts) < 8 OR hour(ts) >= 18) GROUP BY 1""",
    "compliance_night_times": f"""WITH {AUDIT} SELECT "user", strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, row_number() OVER (PARTITION BY "user" ORDER BY ts) AS position
 FROM audit WHERE {_PERIOD} AND (hour(ts) < 8 OR hour(ts) >= 18)""",
    "compliance_weekdays": f"WITH {AUDIT} SELECT dayofweek(ts) + 1 AS weekday, dayname(ts) AS day_name, count(*) AS operations FROM audit WHERE {_PERIOD} GROUP BY 1, 2",
    "compliance_retention": f"WITH {AUDIT} SELECT count(*) AS records, min(ts) AS oldest, max(ts) AS newest, date_diff('day', min(ts), max(ts)) AS days FROM audit",
    "large_count": f"{STAR} SELECT count(*) AS transactions, CAST(sum(tx.amount) AS DOUBLE) AS amount FROM tx WHERE ts = DATE '1998-03-02' AND tx.amount > 30000",
    "purge": "SELECT event_id, ts, user_id, event_type, round(value, 4) AS value, props FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'",
    "purge_count": "SELECT count(*) AS rows FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00'",
    "purge_audit": "SELECT 'PURGE' AS action, count(*) AS rows, TIMESTAMP '2024-01-15 12:00:00' AS cutoff FROM events WHERE ts < TIMESTAMP '2024-01-15 12:00:00'",
    "purge_audit_rows": f"""WITH {AUDIT} SELECT event_id, "table", "user", op, ts FROM audit WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'""",
    "retain_archived": f"""WITH {AUDIT} SELECT event_id, "table", "user", op, ts FROM audit WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-15 12:00:00'""",
    "retain_audit": """SELECT 'total' AS stage, count(*) AS rows FROM events UNION ALL SELECT 'archived', count(*) FROM events
 WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-15 12:00:00' UNION ALL SELECT 'kept', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'""",
    "slowest": f"""WITH {QLOG} SELECT event_id, ts, object, app, CAST(q.duration AS DOUBLE) AS duration, query_id, plan_id, session, name,
 row_number() OVER (ORDER BY q.duration DESC, event_id) AS place FROM q ORDER BY q.duration DESC, event_id LIMIT 25""",
    "by_object": f"WITH {QLOG} SELECT object, {_DUR} FROM q GROUP BY 1",
    "by_app": f"WITH {QLOG} SELECT app, {_DUR} FROM q GROUP BY 1",
    "by_hour": f"WITH {QLOG} SELECT hour(ts) AS hour, {_DUR} FROM q GROUP BY 1",
    "duration_stats": f"WITH {QLOG} SELECT query_id, plan_id, {_DUR} FROM q GROUP BY 1, 2",
    "session_counts": f"WITH {QLOG} SELECT session, name, count(*) AS events FROM q GROUP BY 1, 2",
    "parse_events": f"WITH {PARSED} SELECT event_id, name, ts, CAST(pe.duration AS DOUBLE) AS duration, reads, query_hash, login FROM pe",
    "by_hash": f"""WITH {PARSED} SELECT query_hash, count(*) AS executions, round(CAST(sum(duration) AS DOUBLE) / count(*), 4) AS average,
 CAST(max(duration) AS DOUBLE) AS longest, CAST(sum(duration) AS DOUBLE) AS total FROM pe GROUP BY 1""",
    "recent_errors": f"""WITH {PARSED} SELECT event_id, name, ts, CAST(pe.duration AS DOUBLE) AS duration, reads, query_hash, login, rank() OVER (ORDER BY ts DESC) AS position FROM pe
 WHERE name = 'error' AND ts >= TIMESTAMP '2024-01-23 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'""",
    "errors_by_number": f"WITH {ELOG} SELECT CAST(number AS BIGINT) AS number, count(*) AS errors, min(ts) AS first_ts, max(ts) AS last_ts FROM el GROUP BY 1",
    "errors_by_hour": f"WITH {ELOG} SELECT hour(ts) AS hour, count(*) AS errors FROM el GROUP BY 1",
    "errors_by_procedure": f"WITH {ELOG} SELECT coalesce(procedure, 'Ad-hoc') AS procedure, count(*) AS errors, count(DISTINCT number) AS numbers FROM el GROUP BY 1",
    "classify_errors": f"""WITH {ELOG} SELECT event_id, ts, CAST(number AS BIGINT) AS number, severity, procedure, CASE WHEN event_id % 9 < 4 THEN 'transient' WHEN event_id % 9 < 8 THEN 'permanent' ELSE 'other' END AS kind,
 CASE WHEN severity <= 10 THEN 'information' WHEN severity <= 16 THEN 'user' WHEN severity <= 19 THEN 'resource' ELSE 'fatal' END AS band FROM el""",
    "run_history": f"""WITH {RUNS} SELECT run_id, job, step_id, status, run_ts, duration_hhmmss, {_RESULT} AS result, seconds FROM runs
 WHERE step_id = 0 AND status = 1 AND run_ts >= TIMESTAMP '2024-01-18 12:00:00' AND run_ts <= TIMESTAMP '2024-01-25 12:00:00'""",
    "run_failures": f"""WITH {RUNS} SELECT job, count(*) AS failures, max(run_ts) AS last_failure FROM runs WHERE status = 0
 AND run_ts >= TIMESTAMP '2024-01-24 12:00:00' AND run_ts <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY 1""",
    "running": f"WITH {RUNS} SELECT job, run_ts, date_diff('minute', run_ts, TIMESTAMP '2024-01-30') AS minutes FROM runs WHERE status = 4",
    "run_dashboard": f"""WITH {RUNS}, o AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY run_ts DESC, run_id DESC) AS rn FROM runs
 WHERE step_id = 0 AND run_ts <= TIMESTAMP '2024-01-25 12:00:00')
 SELECT o.job AS job, max(run_ts) FILTER (rn = 1) AS last_run, max({_RESULT}) FILTER (rn = 1) AS last_result,
 round(CAST(sum(seconds) FILTER (rn <= 5) AS DOUBLE) / count(*) FILTER (rn <= 5), 4) AS average_seconds,
 round(count(*) FILTER (status = 1 AND run_ts >= TIMESTAMP '2023-12-25 12:00:00') * CAST(100.0 AS DOUBLE) / count(*) FILTER (run_ts >= TIMESTAMP '2023-12-25 12:00:00'), 4) AS success_pct,
 (SELECT min(ts) FROM events e WHERE 'job_' || e.user_id % 10 = o.job AND e.ts > TIMESTAMP '2024-01-25 12:00:00') AS next_run
 FROM o GROUP BY o.job""",
    "slow_stream": f"WITH {LOG} SELECT event_id, account_id, ts, place, CAST(log.amount AS DOUBLE) AS duration FROM log WHERE log.amount >= 20",
    "frequency_stream": f"""WITH {LOG}, w AS (SELECT account_id, time_bucket(INTERVAL 6 HOUR, ts) AS start FROM log)
 SELECT account_id, start, start + INTERVAL 6 HOUR AS "end", count(*) AS operations FROM w GROUP BY 1, 2 HAVING count(*) >= 2
 AND start + INTERVAL 6 HOUR <= {_CLOSED}""",
    "frequency_sliding": f"""WITH {LOG}, w AS (SELECT account_id, time_bucket(INTERVAL 3 HOUR, ts) - k * INTERVAL 3 HOUR AS start FROM log, (VALUES (0), (1)) v(k))
 SELECT account_id, start, start + INTERVAL 6 HOUR AS "end", count(*) AS operations FROM w GROUP BY ALL HAVING count(*) >= 3 AND "end" <= {_CLOSED}""",
    "activity_stream": f"""WITH {LOG}, h AS (SELECT date_trunc('hour', ts) AS start, place, amount FROM log)
 SELECT start, place, count(*) AS events, CAST(sum(amount) AS DOUBLE) AS amount FROM h GROUP BY 1, 2 HAVING start + INTERVAL 1 HOUR <= {_CLOSED}""",
    "session_stream": f"""WITH {LOG}, g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM log WINDOW w AS (PARTITION BY account_id ORDER BY ts)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY account_id ORDER BY ts) AS session FROM g)
 SELECT account_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS events FROM n GROUP BY account_id, session
 HAVING max(ts) + INTERVAL 2 HOUR <= {_CLOSED}""",
    "travel_stream": f"""{_LAGGED} SELECT event_id, account_id, ts, place, previous_place FROM lg WHERE place <> previous_place AND date_diff('minute', previous_ts, ts) < 30""",
    "cdc_stream": """WITH f AS (SELECT event_id AS seq, CASE WHEN event_id % 11 < 2 THEN 2 WHEN event_id % 11 = 2 THEN 1 WHEN event_id % 11 = 3 THEN 3 ELSE 4 END AS op,
 user_id * 100 + event_id % 17 AS key, event_type AS kind, CAST(value AS DECIMAL(18,2)) AS amount FROM events)
 SELECT key, arg_max(kind, seq) AS kind, CAST(arg_max(amount, seq) AS DOUBLE) AS amount FROM f WHERE op <> 3 GROUP BY key HAVING arg_max(op, seq) <> 1""",
}
