"""Loads, layouts, restartable jobs and worklists: queries that write a table and read it back."""

from __future__ import annotations

import uuid
import zlib
from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.basics import ACC_COLS, TX_COLS
from checks.changes import FEED, feed
from checks.common import in_order, on_bank, on_tables
from checks.reports import _ACTIVITY, STAR, STATEMENT_CLIENT
from ledgerkit.functions import predicates as p
from ledgerkit.operators import history, joins, merge, quality, sample, search
from ledgerkit.plans import reports
from ledgerkit.session import checkpoint_dir
from ledgerkit.sources import bank as views
from ledgerkit.sources import generate, readers
from ledgerkit.sources.readers import load

NOW = "2024-01-25 12:00:00"


def work(spark):
    return f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"


def part_file(spark, folder):
    """The parts as a CSV file in which every ninth price is text."""
    path, key = work(spark), F.col("p_partkey")
    load(spark, folder, "part").select(
        key, "p_name", F.when(key % 9 == 4, "unknown").otherwise(F.col("p_retailprice").cast("decimal(18,2)").cast("string")).alias("price")
    ).write.option("header", True).csv(path)
    schema = T.StructType([T.StructField("part_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("price", T.DecimalType(18, 2))])
    return readers.load_csv(spark, path, schema)


def on_lookups(fn):
    """A query over the star laid out for lookups, which is written once a session."""
    return on_tables(lambda spark, folder: fn(
        views.lookup_bank(spark, folder, f"{checkpoint_dir(spark)}/lookup-{zlib.crc32(folder.encode())}")))


def laid_out(spark, folder):
    path = work(spark)
    readers.write_layout(views.transactions(spark, folder), path, ["state"], ["ts", "account_id"])
    back = spark.read.parquet(path)
    return back.filter((F.col("state") == "F") & p.in_month("ts", 1998, 6)).select(
        "account_id", "line", "part_id", "supplier_id", "type", "state", "amount", "ts")


def rolled_logs(spark, folder):
    """The events as JSON files in one folder per type, read again by wildcard."""
    path = work(spark)
    e = load(spark, folder, "events")
    e.select("event_id", "event_type", "value").write.partitionBy("event_type").json(path)
    logs = readers.load_log_files(spark, path + "/event_type=*", "json", "event_id long, value double")
    return logs.select("event_id", F.col("value").cast("decimal(18,2)").alias("value"))


def copied(spark, folder):
    path, size = work(spark), 4000
    rows = views.accounts(spark, folder)
    copy = lambda df: merge.update_where(df, F.col("state") == "P", {"state": F.lit("X")})
    merge.run_batches(rows, "account_id", size, path, copy, max_batches=1)
    merge.run_batches(rows, "account_id", size, path, copy)
    return spark.read.schema(rows.schema).parquet(path + "/data/*")


def progress(spark, folder):
    """One process per user, from its first to its last event."""
    e = load(spark, folder, "events").groupBy(F.col("user_id").alias("process_id")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("updated"), F.count(F.lit(1)).alias("rows"))
    return merge.batch_progress(e.withColumns({"name": F.lit("load"), "state": F.lit("DONE")}), NOW)


def consumed(spark, folder):
    """The change feed taken in two runs."""
    path, changes = work(spark), feed(spark, folder)

    def write(rows, run):
        rows.write.mode("overwrite").parquet(f"{path}/out/run={run}")

    history.consume_changes(changes.filter("seq <= 600"), path + "/state", write)
    history.consume_changes(changes, path + "/state", write)
    return spark.read.parquet(path + "/out").withColumn("run", F.col("run").cast("long"))


def loaded(spark, folder):
    """Client names trimmed and loaded without the clients that have no segment."""
    path = work(spark)
    rows = load(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"))
    quality.stage_and_load(rows, ["name"], ["segment"], path)
    return spark.read.parquet(path)


def migrated(spark, folder):
    rows = views.transactions(spark, folder)
    split = lambda df: quality.validate_split(df, [("SMALL", F.col("amount") >= 3000)])
    return quality.migrate(rows, split, work(spark), 0.5)


def alert_rows(spark, folder):
    e = F.col("event_id")
    return load(spark, folder, "events").select(
        e.alias("alert_id"), F.when(F.col("event_type") == "error", "FRAUD").otherwise("LIMIT").alias("type"), (e % 5 + 1).alias("severity"), "ts",
        F.when(F.col("user_id") % 3 == 0, "CLOSED").otherwise("OPEN").alias("state"), F.concat(F.lit("analyst_"), F.col("user_id") % 6).alias("analyst"))


ALERTS = """al AS (SELECT event_id AS alert_id, CASE WHEN event_type = 'error' THEN 'FRAUD' ELSE 'LIMIT' END AS type, event_id % 5 + 1 AS severity, ts,
 CASE WHEN user_id % 3 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS state, 'analyst_' || user_id % 6 AS analyst FROM events)"""


def letters(b):
    """Name and credit of each client; a negative credit is an error."""
    text = F.concat(F.col("name"), F.lit(": "), F.col("credit").cast("string"))
    return reports.client_reports(b.clients, text, [(F.col("credit") < 0, "negative credit")])


def consolidated(b):
    """The consolidated balances brought up to date from an older, smaller table."""
    source = reports.consolidated(b)
    old = source.filter(F.col("client_id") % 3 > 0).withColumn(
        "balance", F.when(F.col("client_id") % 2 == 0, F.col("balance") - 1).otherwise(F.col("balance")).cast("decimal(28,2)"))
    return merge.upsert(old, source, ["client_id"], ["balance", "accounts", "last_opened"]).actions.select("client_id", "action", "deleted_balance", "inserted_balance")


def copied_table(spark, folder):
    """The accounts as a view, then as a table of the same structure that takes the view's rows."""
    rows, name = views.accounts(spark, folder), f"copy_{uuid.uuid4().hex}"
    readers.materialize(rows, "ledgerkit_copy")
    empty = readers.materialize(readers.structure_only(spark.table("ledgerkit_copy")), name, "table", work(spark))
    spark.table("ledgerkit_copy").select(*empty.columns).write.insertInto(name)
    return spark.table(name)


def emptied(spark, folder):
    """The accounts' columns after the table was emptied and loaded again."""
    path, rows = work(spark), views.accounts(spark, folder)
    rows.write.parquet(path)
    readers.truncate(spark, path, rows.schema)
    readers.append_rows(rows, path)
    return spark.read.parquet(path)


def appended(spark, folder):
    """The keys that an append to a table of the finished accounts reports."""
    path, rows = work(spark), views.accounts(spark, folder)
    readers.append_rows(rows.filter("state = 'F'"), path)
    keys = readers.append_rows(rows.filter("state <> 'F'"), path, ["account_id", "client_id"])
    # Only keys that are in the table count as inserted.
    return keys.join(spark.read.parquet(path).select("account_id"), "account_id", "left_semi")


def log_rows(spark, folder):
    return load(spark, folder, "events").select("event_id", "event_type", F.col("value").cast("decimal(18,2)").alias("value"))


def text_logs(spark, folder):
    """The events as lines of rolled text files, split again."""
    path = work(spark)
    log_rows(spark, folder).select(F.concat_ws(" ", "event_id", F.concat(F.lit("type="), "event_type"), F.concat(F.lit("value="), "value"))).write.text(path)
    parts = F.split("value", " ")
    return readers.load_log_files(spark, path + "/*.txt").select(
        parts[0].cast("long").alias("event_id"), F.substring_index(parts[1], "=", -1).alias("event_type"),
        F.substring_index(parts[2], "=", -1).cast("decimal(18,2)").alias("value"))


def xml_logs(spark, folder):
    path = work(spark)
    log_rows(spark, folder).write.format("xml").option("rowTag", "event").save(path)
    return readers.load_log_files(spark, path, "xml", "event_id long, event_type string, value decimal(18,2)").drop("file")


def bucketed(spark, folder):
    """Both sides in buckets of the account, so the join needs no shuffle."""
    name = uuid.uuid4().hex
    readers.write_bucketed(views.transactions(spark, folder).select("account_id", "amount"), f"tx_{name}", "account_id", 8, work(spark))
    readers.write_bucketed(views.accounts(spark, folder).select("account_id", "type"), f"acc_{name}", "account_id", 8, work(spark))
    joined = spark.table(f"tx_{name}").join(spark.table(f"acc_{name}").hint("merge"), "account_id")
    return joined.groupBy("type").agg(F.count(F.lit(1)).alias("tx_count"), F.sum("amount").alias("amount"))


def gated(spark, folder):
    """Accounts by type, handed out after the check that none is without one."""
    rows = views.accounts(spark, folder)
    quality.assert_none(rows, F.col("type").isNull(), "accounts without a type")
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("accounts"))


def calendar(spark, folder):
    """Every day of a month with the number of orders, also the days without any."""
    orders = load(spark, folder, "orders").filter(p.in_month("o_orderdate", 1998, 2)).groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    return generate.month_days(spark, date(1998, 2, 10)).join(orders, "date", "left").fillna(0, ["orders"])


def bound(spark, folder):
    views.accounts(spark, folder).createOrReplaceTempView("ledgerkit_accounts")
    return search.run_sql(spark, """SELECT account_id, client_id, state, type, balance, opened FROM IDENTIFIER(:t)
 WHERE type = :kind AND balance >= :low""", t="ledgerkit_accounts", kind="2-HIGH", low=150000)


def from_function(spark, folder):
    """Accounts of a state over a bound through a table function, called with bound values."""
    views.accounts(spark, folder).createOrReplaceTempView("ledgerkit_accounts")
    search.table_function(
        spark, "ledgerkit_large", "wanted STRING, low DECIMAL(18,2)",
        "SELECT account_id, client_id, state, type, balance, opened FROM ledgerkit_accounts WHERE state = wanted AND balance >= low")
    return search.run_sql(spark, "SELECT * FROM ledgerkit_large(:state, CAST(:low AS DECIMAL(18,2)))", state="O", low=200000)


def rated(spark, folder):
    """Accounts with the rate of their type, from inline rows."""
    rates = readers.inline(spark, "type string, rate string", [("1-URGENT", "0.02"), ("5-LOW", "0.04")])
    return joins.with_lookups(views.accounts(spark, folder).select("account_id", "type"), [(rates, "type", "type", "r_")])


QUERIES = {
    "bulk_load": on_tables(lambda s, d: part_file(s, d)[0]),
    "bulk_load_errors": on_tables(lambda s, d: part_file(s, d)[1].agg(F.count(F.lit(1)).alias("bad_rows"))),
    "layout_scan": on_tables(laid_out),
    "log_files": on_tables(rolled_logs),
    "batch_copy": on_tables(copied),
    "batch_progress": on_tables(progress),
    "consume_changes": on_tables(consumed),
    "stage_and_load": on_tables(loaded),
    "migrate": on_tables(migrated),
    "alert_queue": on_tables(lambda s, d: in_order(
        reports.alert_queue(alert_rows(s, d), NOW, 4, 50)[0], "ts", "severity", "alert_id")),
    "alerts_per_analyst": on_tables(lambda s, d: reports.alert_queue(alert_rows(s, d), NOW)[1]),
    "fraud_last_month": on_tables(lambda s, d: reports.alert_queue(alert_rows(s, d), NOW)[2]),
    "client_letters": on_bank(letters),
    "client_letter_counts": on_bank(lambda b: reports.report_counts(letters(b))),
    "consolidate": on_bank(consolidated),
    "materialize": on_tables(copied_table),
    "truncate": on_tables(emptied),
    "assert_none": on_tables(gated),
    "month_calendar": on_tables(calendar),
    "bound_values": on_tables(bound),
    "table_function": on_tables(from_function),
    "inline_rates": on_tables(rated),
    "balance_lookup": on_lookups(lambda b: reports.balance(b, 77)),
    "lookup_layout": on_lookups(lambda b: readers.rows_by_key(b.accounts, "client_id", 77)),
    "statement_client": on_lookups(lambda b: reports.statement(b, [77], "1998-01-01", "1999-01-01").drop("state")),
    "list_ordered": on_bank(lambda b: in_order(
        search.list_ordered(b.clients.select("client_id", "name"), {"id": "client_id", "newest": "-client_id"}, "newest", "client_id"), "client_id")),
    "sample_share": on_bank(lambda b: sample.stratified(b.accounts, ["type"], ["account_id"], 0.13, 7)),
    "append_keys": on_tables(appended),
    "log_text": on_tables(text_logs),
    "log_xml": on_tables(xml_logs),
    "bucketed_join": on_tables(bucketed),
    "or_filter": on_bank(lambda b: b.tx.filter((F.col("type") == "R") | (F.col("amount") > 70000))),
}

SQL = {
    "bulk_load": "SELECT p_partkey AS part_id, p_name AS name, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS DOUBLE) AS price FROM part WHERE p_partkey % 9 <> 4",
    "bulk_load_errors": "SELECT count(*) AS bad_rows FROM part WHERE p_partkey % 9 = 4",
    "layout_scan": f"{STAR} SELECT {TX_COLS} FROM tx WHERE state = 'F' AND ts >= DATE '1998-06-01' AND ts < DATE '1998-07-01'",
    "log_files": "SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value FROM events",
    "batch_copy": f"{STAR} SELECT account_id, client_id, CASE state WHEN 'P' THEN 'X' ELSE state END AS state, type, CAST(acc.balance AS DOUBLE) AS balance, opened FROM acc",
    "batch_progress": """SELECT user_id AS process_id, 'load' AS name, 'DONE' AS state, count(*) AS rows, date_diff('minute', min(ts), max(ts)) AS minutes,
 CASE WHEN date_diff('minute', min(ts), max(ts)) > 0 THEN round(CAST(count(*) AS DOUBLE) / date_diff('minute', min(ts), max(ts)), 4) END AS rows_per_minute FROM events GROUP BY 1""",
    "consume_changes": f"""WITH {FEED} SELECT seq, CAST(op AS BIGINT) AS op, key, kind, CAST(amount AS DOUBLE) AS amount,
 CASE op WHEN 1 THEN 'DELETE' WHEN 2 THEN 'INSERT' WHEN 3 THEN 'UPDATE BEFORE' ELSE 'UPDATE AFTER' END AS operation,
 CAST(CASE WHEN seq <= 600 THEN 1 ELSE 2 END AS BIGINT) AS run FROM feed""",
    "stage_and_load": "SELECT c_custkey, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "migrate": """SELECT 'read' AS stage, count(*) AS rows FROM lineitem UNION ALL SELECT 'rejected', count(*) FROM lineitem WHERE CAST(l_extendedprice AS DECIMAL(18,2)) < 3000
 UNION ALL SELECT 'written', count(*) FROM lineitem WHERE CAST(l_extendedprice AS DECIMAL(18,2)) >= 3000""",
    "alert_queue": f"WITH {ALERTS} SELECT *, rank() OVER (ORDER BY ts DESC, severity DESC, alert_id) AS position FROM al WHERE state = 'OPEN' AND severity >= 4 ORDER BY ts DESC, severity DESC, alert_id LIMIT 50",
    "alerts_per_analyst": f"WITH {ALERTS} SELECT analyst, type, state, count(*) AS alerts FROM al GROUP BY 1, 2, 3",
    "fraud_last_month": f"WITH {ALERTS} SELECT * FROM al WHERE type = 'FRAUD' AND ts >= TIMESTAMP '2023-12-25 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00'",
    "client_letters": f"""{STAR} SELECT client_id, CASE WHEN credit >= 0 THEN name || ': ' || CAST(credit AS VARCHAR) END AS report,
 CASE WHEN credit < 0 THEN 'negative credit' END AS error FROM cli""",
    "client_letter_counts": f"{STAR} SELECT count(*) FILTER (credit >= 0) AS succeeded, count(*) FILTER (credit < 0) AS failed FROM cli",
    "consolidate": f"""{_ACTIVITY} SELECT client_id, CASE WHEN client_id % 3 = 0 THEN 'INSERT' ELSE 'UPDATE' END AS action,
 CASE WHEN client_id % 3 > 0 THEN CAST(coalesce(balance, 0) - 1 AS DOUBLE) END AS deleted_balance, CAST(coalesce(balance, 0) AS DOUBLE) AS inserted_balance
 FROM cli LEFT JOIN bal USING (client_id) WHERE client_id % 3 = 0 OR client_id % 2 = 0""",
    "materialize": f"{STAR} SELECT {ACC_COLS} FROM acc",
    "truncate": f"{STAR} SELECT {ACC_COLS} FROM acc",
    "assert_none": f"{STAR} SELECT type, count(*) AS accounts FROM acc GROUP BY 1",
    "month_calendar": """SELECT strftime(d, '%Y-%m-%d') AS date, count(o_orderkey) AS orders
 FROM (SELECT unnest(generate_series(DATE '1998-02-01', DATE '1998-02-28', INTERVAL 1 DAY)) AS d) LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d GROUP BY 1""",
    "bound_values": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE type = '2-HIGH' AND acc.balance >= 150000",
    "table_function": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE state = 'O' AND acc.balance >= 200000",
    "inline_rates": """SELECT o_orderkey AS account_id, o_orderpriority AS type, CASE o_orderpriority WHEN '1-URGENT' THEN '0.02' WHEN '5-LOW' THEN '0.04' END AS r_rate FROM orders""",
    "balance_lookup": f"{STAR} SELECT account_id, CAST(acc.balance AS DOUBLE) AS balance, state FROM acc WHERE account_id = 77",
    "lookup_layout": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE client_id = 77",
    "statement_client": STATEMENT_CLIENT,
    "list_ordered": f"{STAR} SELECT client_id, name, rank() OVER (ORDER BY client_id DESC) AS position FROM cli",
    "sample_share": f"""{STAR}, n AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY CAST('0x' || substr(md5('7|' || CAST(account_id AS VARCHAR)), 1, 15) AS BIGINT), account_id) AS rn,
 count(*) OVER (PARTITION BY type) AS c FROM acc) SELECT {ACC_COLS} FROM n AS acc WHERE rn <= ceil(c * CAST(0.13 AS DOUBLE))""",
    "append_keys": f"{STAR} SELECT account_id, client_id FROM acc WHERE state <> 'F'",
    "log_text": "SELECT event_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value FROM events",
    "log_xml": "SELECT event_id, event_type, CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value FROM events",
    "bucketed_join": f"{STAR} SELECT acc.type, count(*) AS tx_count, CAST(sum(amount) AS DOUBLE) AS amount FROM tx JOIN acc USING (account_id) GROUP BY 1",
    "or_filter": f"{STAR} SELECT {TX_COLS} FROM tx WHERE type = 'R' UNION ALL SELECT {TX_COLS} FROM tx WHERE tx.amount > 70000 AND type IS DISTINCT FROM 'R'",
}
