"""Merges, history, audit, change feeds, cleansing and ledger posting."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.common import AS_OF, on_bank, on_tables
from checks.basics import ACC_COLS, TX_COLS
from checks.reports import STAR
from ledgerkit.operators import history, ledger, merge, ordered, quality
from ledgerkit.plans import reports
from ledgerkit.sources import bank as views
from ledgerkit.sources.readers import load

# Part tables: the stored one, and a later delivery with changed, missing and added rows.


def parts(spark, folder):
    return load(spark, folder, "part").select(
        F.col("p_partkey").alias("part_id"), F.col("p_name").alias("name"), F.nullif(F.col("p_brand"), F.lit("Brand#5")).alias("brand"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"), (F.col("p_size") > 3).alias("active"))


def delivery(spark, folder):
    p = load(spark, folder, "part")
    price = F.col("p_retailprice").cast("decimal(18,2)")
    key = F.col("p_partkey")
    seen = p.filter(key % 10 != 3).select(
        key.alias("part_id"), F.col("p_name").alias("name"),
        F.when(key % 13 == 0, None).otherwise(F.col("p_brand")).alias("brand"),
        F.when(key % 7 == 0, price + 10).otherwise(price).cast("decimal(18,2)").alias("price"))
    added = p.filter(key % 20 == 1).select(
        (key + 1000000000).alias("part_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), price.alias("price"))
    return seen.unionByName(added)


PARTS = """old AS (SELECT p_partkey AS part_id, p_name AS name, nullif(p_brand, 'Brand#5') AS brand,
 CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_size > 3 AS active FROM part),
new AS (SELECT p_partkey AS part_id, p_name AS name, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS brand,
 CAST(CAST(p_retailprice AS DECIMAL(18,2)) + CASE WHEN p_partkey % 7 = 0 THEN 10 ELSE 0 END AS DECIMAL(18,2)) AS price
 FROM part WHERE p_partkey % 10 <> 3
 UNION ALL SELECT p_partkey + 1000000000, p_name, p_brand, CAST(p_retailprice AS DECIMAL(18,2)) FROM part WHERE p_partkey % 20 = 1),
m AS (SELECT coalesce(o.part_id, n.part_id) AS part_id,
 CASE WHEN o.part_id IS NULL THEN 'INSERT' WHEN n.part_id IS NULL AND o.active THEN 'DEACTIVATE' WHEN n.part_id IS NULL THEN 'KEEP'
  WHEN (o.name, o.brand, o.price) IS DISTINCT FROM (n.name, n.brand, n.price) THEN 'UPDATE' ELSE 'KEEP' END AS action,
 o.name AS o_name, o.brand AS o_brand, o.price AS o_price, o.active AS o_active, n.name AS n_name, n.brand AS n_brand, n.price AS n_price
 FROM old o FULL JOIN new n ON o.part_id = n.part_id)"""


def merged(mode):
    return lambda s, d: merge.upsert(parts(s, d), delivery(s, d), ["part_id"], ["name", "brand", "price"], mode)


# Supplier dimension with two versions of some suppliers.

def dimension(spark, folder):
    s = load(spark, folder, "supplier")
    key, day = F.col("s_suppkey"), lambda t: F.lit(t).cast("date")
    live = s.filter(key % 6 != 5).select(
        (key * 2 + 1).alias("sk"), key.alias("supplier_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        day("2000-01-01").alias("start"), F.lit(None).cast("date").alias("end"), F.lit(True).alias("current"))
    past = s.filter(key % 4 == 0).select(
        (key * 2).alias("sk"), key.alias("supplier_id"), F.concat(F.lit("Old "), "s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        day("1998-01-01").alias("start"), day("1999-12-31").alias("end"), F.lit(False).alias("current"))
    return live.unionByName(past)


def suppliers_now(spark, folder):
    key = F.col("s_suppkey")
    return load(spark, folder, "supplier").filter(key % 9 != 7).select(
        key.alias("supplier_id"), F.col("s_name").alias("name"),
        F.when(key % 5 == 0, F.col("s_nationkey") + 100).otherwise(F.col("s_nationkey")).cast("int").alias("nation"))


DIM = """dim AS (SELECT s_suppkey * 2 + 1 AS sk, s_suppkey AS supplier_id, s_name AS name, s_nationkey AS nation, '2000-01-01' AS start,
 CAST(NULL AS VARCHAR) AS "end", TRUE AS current FROM supplier WHERE s_suppkey % 6 <> 5
 UNION ALL SELECT s_suppkey * 2, s_suppkey, 'Old ' || s_name, s_nationkey, '1998-01-01', '1999-12-31', FALSE FROM supplier WHERE s_suppkey % 4 = 0),
src AS (SELECT s_suppkey AS supplier_id, s_name AS name, s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 100 ELSE 0 END AS nation
 FROM supplier WHERE s_suppkey % 9 <> 7),
act AS (SELECT src.*, d.supplier_id AS had, CASE WHEN d.supplier_id IS NULL THEN 'NEW' WHEN d.nation <> src.nation OR d.name <> src.name
 THEN 'CHANGE' ELSE 'SAME' END AS action FROM src LEFT JOIN (SELECT * FROM dim WHERE current) d USING (supplier_id))"""


def event_versions(spark, folder):
    """Every event is a change of the state of its user."""
    e = load(spark, folder, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    return history.versions(e, ["user_id"], "ts", "event_id")


def open_as_null(df):
    """The open end as null, so that it fits every client's time type."""
    return df.withColumn("valid_to", F.nullif(F.col("valid_to"), F.lit(history.OPEN_END).cast("timestamp_ntz")))


VERSIONS = """ver AS (SELECT event_id, user_id, ts AS valid_from, event_type, round(value, 4) AS value,
 lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events)"""
VER_COLS = "event_id, user_id, valid_from, event_type, value, valid_to"


def feed(spark, folder):
    """The events as a change feed: one row per event, operation by event id."""
    e = load(spark, folder, "events")
    n = F.col("event_id") % 11
    op = F.when(n < 2, history.INSERT).when(n == 2, history.DELETE).when(n == 3, history.BEFORE).otherwise(history.AFTER)
    return e.select(F.col("event_id").alias("seq"), op.alias("op"),
                    (F.col("user_id") * 100 + F.col("event_id") % 17).alias("key"),
                    F.col("event_type").alias("kind"), F.col("value").cast("decimal(18,2)").alias("amount"))


FEED = """feed AS (SELECT event_id AS seq, CASE WHEN event_id % 11 < 2 THEN 2 WHEN event_id % 11 = 2 THEN 1
 WHEN event_id % 11 = 3 THEN 3 ELSE 4 END AS op, user_id * 100 + event_id % 17 AS key, event_type AS kind,
 CAST(value AS DECIMAL(18,2)) AS amount FROM events)"""
NET = """ends AS (SELECT key, arg_min(op, seq) AS f, arg_max(op, seq) AS l, max(seq) AS s, arg_max(kind, seq) AS k, arg_max(amount, seq) AS a
 FROM feed WHERE op <> 3 AND seq BETWEEN 500 AND 100000000 GROUP BY key),
net AS (SELECT CASE WHEN f = 2 AND l <> 1 THEN 2 WHEN f <> 2 AND l = 1 THEN 1 WHEN f <> 2 THEN 4 END AS op, key, s AS seq, k AS kind, a AS amount FROM ends)"""


def dirty(spark, folder):
    """Orders as import text with all kinds of mistakes."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    price = F.col("o_totalprice").cast("decimal(10,2)").cast("string")
    return load(spark, folder, "orders").select(
        k.alias("id"),
        F.when(k % 17 == 0, None).when(k % 17 == 1, F.date_format(day, "dd/MM/yyyy")).when(k % 17 == 2, "2024-13-45")
        .when(k % 17 == 3, "").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("date_text"),
        F.when(k % 13 == 0, "mil").when(k % 13 == 1, None).when(k % 13 == 2, F.concat(F.lit("1,"), F.lit("234.50"))).otherwise(price).alias("amount_text"),
        F.when(k % 19 == 0, "5abc").when(k % 19 == 1, None).otherwise((k % 50).cast("string")).alias("qty_text"),
        F.when(k % 23 == 0, "no at sign").otherwise(F.concat(F.lit("c"), "o_custkey", F.lit("@bank.example"))).alias("email_text"),
    )


FIELDS = [
    quality.Field("date_text", "date", "ERROR_DATE", required=True),
    quality.Field("amount_text", "decimal(10,2)", "ERROR_AMOUNT", required=True, grouping=","),
    quality.Field("qty_text", "int", "ERROR_QUANTITY"),
    quality.Field("email_text", "email", "ERROR_EMAIL"),
]

DIRTY = """dirty AS (SELECT o_orderkey AS id, CASE o_orderkey % 17 WHEN 0 THEN NULL WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN '2024-13-45'
  WHEN 3 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
 CASE o_orderkey % 13 WHEN 0 THEN 'mil' WHEN 1 THEN NULL WHEN 2 THEN '1,234.50' ELSE CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS VARCHAR) END AS amount_text,
 CASE o_orderkey % 19 WHEN 0 THEN '5abc' WHEN 1 THEN NULL ELSE CAST(o_orderkey % 50 AS VARCHAR) END AS qty_text,
 CASE WHEN o_orderkey % 23 = 0 THEN 'no at sign' ELSE 'c' || o_custkey || '@bank.example' END AS email_text FROM orders),
conv AS (SELECT *, CASE WHEN o_date LIKE '____-__-__' AND try_cast(o_date AS DATE) IS NOT NULL THEN o_date END AS d,
 try_cast(replace(amount_text, ',', '') AS DECIMAL(10,2)) AS a, try_cast(qty_text AS INTEGER) AS q FROM (SELECT *, date_text AS o_date FROM dirty)),
clean AS (SELECT *, CASE WHEN d IS NULL AND date_text <> '' THEN 'ERROR_DATE' WHEN a IS NULL AND amount_text <> '' THEN 'ERROR_AMOUNT'
 WHEN q IS NULL AND qty_text <> '' THEN 'ERROR_QUANTITY' WHEN email_text NOT LIKE '%@%.%' THEN 'ERROR_EMAIL'
 WHEN date_text IS NULL OR amount_text IS NULL THEN 'NULL_DATA' ELSE 'OK' END AS status FROM conv)"""


def foreign(spark, folder):
    """Orders as text in the notation of four countries."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    code = F.element_at(F.array(*[F.lit(c) for c in ("ES", "US", "MX", "DE")]), (k % 4 + 1).cast("int"))
    us = F.format_number(F.col("o_totalprice").cast("decimal(10,2)"), 2)
    swapped = F.translate(us, ",.", ".,")
    return load(spark, folder, "orders").select(
        k.alias("id"), code.alias("country"),
        F.when(k % 29 == 0, "error").when(k % 4 == 0, F.date_format(day, "dd/MM/yyyy")).when(k % 4 == 1, F.date_format(day, "MM/dd/yyyy"))
        .when(k % 4 == 2, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd.MM.yyyy")).alias("date_text"),
        F.when(k % 29 == 0, "error").when(k % 4 == 1, us).when(k % 4 == 2, F.replace(us, F.lit(","), F.lit(""))).otherwise(swapped).alias("amount_text"))


def withdrawal_requests(spark, folder):
    """Tenth of each line item as a withdrawal from the supplier's account, one limit per month."""
    li = load(spark, folder, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("account_id"), F.trunc(F.to_date("l_shipdate"), "month").alias("day"), F.col("l_shipdate").alias("ts"),
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part_id"),
        ((F.col("l_extendedprice").cast("decimal(18,2)") * 100).cast("long") / 1000).cast("decimal(18,2)").alias("amount"))


def supplier_accounts(spark, folder):
    return load(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("account_id"), F.when(F.col("s_suppkey") % 8 == 7, "BLOCKED").otherwise("ACTIVE").alias("state"),
        ((F.col("s_suppkey") % 5) * 100000 + 90000).cast("decimal(18,2)").alias("balance"))


ORDER = ["ts", "order_id", "line", "part_id"]


def transfer_requests(spark, folder):
    """Line items as transfers from their order's account to the account numbered like the part."""
    li = load(spark, folder, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return li.select(
        F.col("l_orderkey").alias("source"), F.when(F.col("l_linenumber") == 7, F.col("l_orderkey")).otherwise(F.col("l_partkey") * 9).alias("dest"),
        F.when(F.col("l_quantity") == 1, -price).when(F.col("l_quantity") == 2, price * 1000).otherwise(price).cast("decimal(18,2)").alias("amount"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier_id"))


def ledger_accounts(spark, folder):
    return views.accounts(spark, folder).select(
        "account_id", F.when(F.col("state") == "F", "CLOSED").otherwise("ACTIVE").alias("state"),
        F.when(F.col("type") == "5-LOW", "TERM").otherwise("CURRENT").alias("type"), "balance")


TRANSFERS = """req AS (SELECT l_orderkey AS source, CASE WHEN l_linenumber = 7 THEN l_orderkey ELSE l_partkey * 9 END AS dest,
 CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CASE l_quantity WHEN 1 THEN -1 WHEN 2 THEN 1000 ELSE 1 END AS DECIMAL(18,2)) AS amount,
 l_linenumber AS line, l_suppkey AS supplier_id FROM lineitem),
la AS (SELECT o_orderkey AS account_id, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS state,
 CASE WHEN o_orderpriority = '5-LOW' THEN 'TERM' ELSE 'CURRENT' END AS type, CAST(o_totalprice AS DECIMAL(18,2)) AS balance FROM orders),
val AS (SELECT req.*, CASE WHEN amount <= 0 THEN 50001 WHEN amount > 1000000 THEN 50002 WHEN source = dest THEN 50003 WHEN s.state IS NULL THEN 50004
 WHEN s.state <> 'ACTIVE' THEN 50005 WHEN s.type = 'TERM' THEN 50006 WHEN s.balance < amount THEN 50007 WHEN d.state IS NULL THEN 50008
 WHEN d.state <> 'ACTIVE' THEN 50009 END AS code FROM req LEFT JOIN la s ON s.account_id = source LEFT JOIN la d ON d.account_id = dest)"""


TRANSFER_ORDER = ["line", "supplier_id", "dest", "amount"]
# Each request of a source sees what the accepted ones before it have left.
POSTED = TRANSFERS + """,
step AS (SELECT req.*, s.balance AS funds, row_number() OVER (PARTITION BY source ORDER BY line, supplier_id, dest, amount) AS rn,
 CASE WHEN amount <= 0 THEN 50001 WHEN amount > 1000000 THEN 50002 WHEN source = dest THEN 50003 WHEN s.state IS NULL THEN 50004
 WHEN s.state <> 'ACTIVE' THEN 50005 WHEN s.type = 'TERM' THEN 50006 END AS f, CASE WHEN d.state IS NULL THEN 50008 WHEN d.state <> 'ACTIVE' THEN 50009 END AS l
 FROM req LEFT JOIN la s ON s.account_id = source LEFT JOIN la d ON d.account_id = dest),
walk AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS rn, CAST(funds AS DECIMAL(38,2)) AS rest, CAST(NULL AS INTEGER) AS code FROM step
 UNION ALL SELECT v.source, v.rn, CAST(w.rest - CASE WHEN f IS NULL AND l IS NULL AND amount <= w.rest THEN amount ELSE 0 END AS DECIMAL(38,2)),
 CASE WHEN f IS NOT NULL THEN f WHEN amount > w.rest THEN 50007 ELSE l END FROM walk w JOIN step v ON v.source = w.source AND v.rn = w.rn + 1),
posted AS (SELECT step.* EXCLUDE (funds, rn, f, l), walk.code FROM step JOIN walk ON step.source = walk.source AND step.rn = walk.rn)"""


def posted_transfers(s, d):
    return ledger.post_transfers(transfer_requests(s, d), ledger_accounts(s, d), TRANSFER_ORDER)


def accepted_transfers(s, d):
    return posted_transfers(s, d).filter("code IS NULL")


def deposit_requests(spark, folder):
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("account_id"), F.col("l_partkey").alias("part_id"), F.col("l_linenumber").alias("line"),
        F.when(F.col("l_quantity") == 3, 0).otherwise(F.col("l_extendedprice")).cast("decimal(18,2)").alias("amount"),
        F.element_at(F.array(*[F.lit(o) for o in ("CASH", "CHEQUE", "OTHER")]), (F.col("l_partkey") % 3 + 1).cast("int")).alias("origin"))


def resegmented(b):
    return merge.resegment(b.clients, b.accounts, [(2500000, "PREMIUM"), (1000000, "GOLD")], "BASIC")


def archived(b):
    """Old transactions; those of transfers are already in the archive."""
    keys = ["account_id", "line", "part_id", "supplier_id"]
    archive = b.tx.filter("type = 'R' AND ts < '1996-01-01'")
    return merge.archive_older(b.tx, archive, keys, "ts", "1997-01-01")


def validated(s, d):
    b = views.bank(s, d)
    req = b.tx.select("account_id", "line", "part_id", "supplier_id", (F.col("amount") - 2000).alias("amount"), "ts")
    return quality.validate_split(
        req, [("NOT_POSITIVE", F.col("amount") > 0), ("FUTURE", F.col("ts") <= "2001-06-01")],
        [("NO_ACCOUNT", b.accounts.filter("state <> 'P'"), "account_id", "account_id")])


def json_before(s, d):
    cols = ["part_id", "name", "brand", "price"]
    return history.audit_diff(parts(s, d).select(*cols), delivery(s, d).select(*cols), None, "part", {"part": ["part_id"]})


def balance_audit(s, d):
    b = views.bank(s, d)
    return history.audit_column(b.accounts, merge.apply_net(b.accounts, b.tx, reports.DEPOSIT), "account_id", "balance")


def event_audit(s, d):
    """The events of an account as changes of one record each, with both images."""
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("long")
    e = load(s, d, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("kind"), cents.alias("cents"))
    rows = ordered.lagged(e, ["user_id"], ["ts", "event_id"], {"old_kind": "kind", "old_cents": "cents"})
    old = F.to_json(F.struct(F.col("old_kind").alias("kind"), F.col("old_cents").alias("cents")))
    first = F.col("old_kind").isNull()
    return rows.select(
        F.when(first, "I").otherwise("U").alias("op"), F.lit("account").alias("table"), F.col("user_id").cast("string").alias("key"),
        F.when(~first, old).alias("before"), F.to_json(F.struct("kind", "cents")).alias("after"), "ts", "event_id")


RECORDS = ("1", "7", "12", "33")


def on(fn):
    return on_tables(fn)


QUERIES = {
    "upsert": on(lambda s, d: merged("deactivate")(s, d).target),
    "upsert_actions": on(lambda s, d: merged("deactivate")(s, d).actions),
    "upsert_delete": on(lambda s, d: merged("delete")(s, d).target.select("part_id", "name", "brand", "price")),
    "update_where": on_bank(lambda b: merge.update_where(b.accounts, (F.col("state") == "P") & (F.col("balance") > 100000), {"state": F.lit("B")})),
    "delete_where": on_bank(lambda b: merge.delete_where(b.accounts, F.col("balance") < 50000)[1]),
    "delete_where_kept": on_bank(lambda b: merge.delete_where(b.accounts, F.col("balance") < 50000)[0]),
    "resegment": on_bank(resegmented),
    "apply_net": on_bank(lambda b: merge.apply_net(b.accounts, b.tx.filter("ts >= '1998-01-01' AND ts < '1998-02-01'"), "A")),
    "renumber": on_bank(lambda b: merge.renumber(b.clients.select("client_id", "name", "credit"), ["-credit", "client_id"])),
    "archive_new": on_bank(lambda b: archived(b)[0]),
    "archive_kept": on_bank(lambda b: archived(b)[1]),
    "mark_inactive": on_bank(lambda b: merge.mark_inactive(b.accounts, b.tx, 365, AS_OF)),
    "scd2": on(lambda s, d: history.scd2_apply(dimension(s, d), suppliers_now(s, d), "supplier_id", ["name", "nation"], AS_OF)[0]),
    "scd2_actions": on(lambda s, d: history.scd2_apply(dimension(s, d), suppliers_now(s, d), "supplier_id", ["name", "nation"], AS_OF)[1]),
    "versions": on(lambda s, d: open_as_null(event_versions(s, d))),
    "as_of": on(lambda s, d: open_as_null(history.as_of(event_versions(s, d), "2024-01-15 12:00:00"))),
    "between": on(lambda s, d: open_as_null(history.between(event_versions(s, d), "2024-01-10", "2024-01-12"))),
    "from_to": on(lambda s, d: open_as_null(history.from_to(event_versions(s, d), "2024-01-10", "2024-01-12"))),
    "contained_in": on(lambda s, d: open_as_null(history.contained_in(event_versions(s, d), "2024-01-10", "2024-01-12"))),
    "version_report": on(lambda s, d: open_as_null(history.version_report(event_versions(s, d), "2024-01-31", "2024-01-05", "2024-01-20"))),
    "trim_history": on(lambda s, d: open_as_null(history.trim_history(event_versions(s, d), 1, "2025-01-16"))),
    "audit_diff": on(json_before),
    "audit_column": on(balance_audit),
    "record_history": on(lambda s, d: history.record_history(event_audit(s, d), "account", RECORDS)),
    "field_changes": on(lambda s, d: history.field_changes(event_audit(s, d), ["event_id", "key", "op", "ts"])),
    "all_changes": on(lambda s, d: history.all_changes(feed(s, d), 500, 4000)),
    "changes_between": on(lambda s, d: history.changes_between(
        feed(s, d).join(load(s, d, "events").select(F.col("event_id").alias("seq"), "ts"), "seq"), "2024-01-10", "2024-01-12").drop("ts")),
    "net_changes": on(lambda s, d: history.net_changes(feed(s, d), ["key"], 500, 100000000)),
    "clean_import": on(lambda s, d: quality.clean_import(dirty(s, d), FIELDS)),
    "error_summary": on(lambda s, d: quality.error_summary(quality.clean_import(dirty(s, d), FIELDS))),
    "error_share": on(lambda s, d: quality.error_share(quality.clean_import(dirty(s, d), FIELDS))),
    "parse_by_country": on(lambda s, d: quality.parse_by_country(foreign(s, d), "country", "date_text", "amount_text").select("id", "country", "day", "amount", "status")),
    "conversion_by_country": on(lambda s, d: quality.conversion_by_country(quality.parse_by_country(foreign(s, d), "country", "date_text", "amount_text"), "country")),
    "valid_rows": on(lambda s, d: validated(s, d)[0]),
    "rejected_rows": on(lambda s, d: validated(s, d)[1]),
    "orphans": on(lambda s, d: quality.orphans(views.transactions(s, d), views.accounts(s, d).filter("state = 'O'"), "account_id", "account_id")),
    "dup_keys": on(lambda s, d: quality.dup_keys(load(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])),
    "profile_types": on(lambda s, d: quality.profile_types(load(s, d, "lineitem"))),
    "validate_transfers": on(lambda s, d: ledger.validate_transfers(transfer_requests(s, d), ledger_accounts(s, d))),
    "post_transfers": on(posted_transfers),
    "validate_deposits": on(lambda s, d: ledger.validate_deposits(deposit_requests(s, d), ledger_accounts(s, d), ["CASH", "CHEQUE"])),
    "apply_postings": on(lambda s, d: ledger.apply_postings(ledger_accounts(s, d), accepted_transfers(s, d))),
    "post_withdrawals": on(lambda s, d: ledger.post_withdrawals(withdrawal_requests(s, d), supplier_accounts(s, d), ORDER)),
    "spread_amount": on(lambda s, d: ledger.spread_amount(ledger_accounts(s, d), 1, 12345.67)),
    "interest": on_bank(lambda b: ledger.accrue_interest(b.accounts, {"1-URGENT": "0.025", "2-HIGH": "0.01", "5-LOW": "0.045"})),
    "commissions": on_bank(lambda b: ledger.commissions(b.tx, "1998-01-01", "1998-04-01", "R", "N", "A", "F")),
    "low_balance": on_bank(lambda b: ledger.low_balance_alerts(b.accounts.withColumn("balance", F.col("balance") - 60000), 1000)),
    "block_negative": on_bank(lambda b: ledger.block_negative(
        b.accounts.withColumns({"balance": F.col("balance") - 60000, "last_move": F.col("opened")}), AS_OF, 300).drop("last_move")),
    "close_day": on_bank(lambda b: ledger.close_day(b.tx, "1998-03-02", "O", "F")[1]),
    "close_day_rows": on_bank(lambda b: ledger.close_day(b.tx, "1998-03-02", "O", "F")[0]),
    "reconcile": on_bank(lambda b: ledger.reconcile(b.accounts, b.tx, "A")),
}

_LINE = "CAST(line AS BIGINT) AS line"

EVENT_AUDIT = """WITH e AS (SELECT event_id, user_id, ts, event_type AS kind, CAST(CAST(value AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents FROM events),
 a AS (SELECT event_id, ts, CAST(user_id AS VARCHAR) AS key, kind, cents, lag(kind) OVER w AS old_kind, lag(cents) OVER w AS old_cents,
 CASE WHEN lag(kind) OVER w IS NULL THEN 'I' ELSE 'U' END AS op FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
_IMAGE = """'{{"kind":"' || {} || '","cents":' || CAST({} AS VARCHAR) || '}}'"""

SQL = {
    "upsert": f"""WITH {PARTS} SELECT part_id, CASE WHEN action IN ('INSERT', 'UPDATE') THEN n_name ELSE o_name END AS name,
 CASE WHEN action IN ('INSERT', 'UPDATE') THEN n_brand ELSE o_brand END AS brand,
 CAST(CASE WHEN action IN ('INSERT', 'UPDATE') THEN n_price ELSE o_price END AS DOUBLE) AS price,
 CASE action WHEN 'INSERT' THEN TRUE WHEN 'DEACTIVATE' THEN FALSE ELSE o_active END AS active FROM m""",
    "upsert_actions": f"""WITH {PARTS} SELECT part_id, action, o_name AS deleted_name, o_brand AS deleted_brand, CAST(o_price AS DOUBLE) AS deleted_price,
 n_name AS inserted_name, n_brand AS inserted_brand, CAST(n_price AS DOUBLE) AS inserted_price FROM m WHERE action <> 'KEEP'""",
    "upsert_delete": f"WITH {PARTS} SELECT part_id, name, brand, CAST(price AS DOUBLE) AS price FROM new",
    "update_where": f"{STAR} SELECT account_id, client_id, CASE WHEN state = 'P' AND acc.balance > 100000 THEN 'B' ELSE state END AS state, type, CAST(acc.balance AS DOUBLE) AS balance, opened FROM acc",
    "delete_where_kept": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE acc.balance >= 50000",
    "delete_where": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE acc.balance < 50000",
    "resegment": f"""{STAR}, s AS (SELECT client_id, sum(balance) AS b FROM acc GROUP BY 1) SELECT client_id, name,
 CASE WHEN b >= 2500000 THEN 'PREMIUM' WHEN b >= 1000000 THEN 'GOLD' WHEN b IS NOT NULL THEN 'BASIC' ELSE segment END AS segment,
 CAST(branch_id AS BIGINT) AS branch_id, CAST(credit AS DOUBLE) AS credit FROM cli LEFT JOIN s USING (client_id)""",
    "apply_net": f"""{STAR}, n AS (SELECT account_id, sum(CASE WHEN type = 'A' THEN amount ELSE -amount END) AS net FROM tx
 WHERE ts >= DATE '1998-01-01' AND ts < DATE '1998-02-01' GROUP BY 1) SELECT account_id, client_id, state, type,
 CAST(acc.balance + coalesce(net, 0) AS DOUBLE) AS balance, opened FROM acc LEFT JOIN n USING (account_id)""",
    "renumber": f"{STAR} SELECT client_id, name, CAST(cli.credit AS DOUBLE) AS credit, row_number() OVER (ORDER BY cli.credit DESC, client_id) AS number FROM cli",
    "archive_new": f"{STAR} SELECT {TX_COLS} FROM tx WHERE ts < DATE '1997-01-01' AND NOT (type = 'R' AND ts < DATE '1996-01-01')",
    "archive_kept": f"{STAR} SELECT {TX_COLS} FROM tx WHERE ts >= DATE '1997-01-01'",
    "mark_inactive": f"""{STAR}, l AS (SELECT account_id, max(ts) AS last_tx FROM tx GROUP BY 1) SELECT account_id, client_id,
 CASE WHEN last_tx IS NULL OR last_tx < DATE '2000-12-01' THEN 'I' ELSE state END AS state, type, CAST(acc.balance AS DOUBLE) AS balance, opened, last_tx
 FROM acc LEFT JOIN l USING (account_id)""",
    "scd2": f"""WITH {DIM} SELECT sk, supplier_id, name, CAST(nation AS BIGINT) AS nation, start, CASE WHEN current AND supplier_id IN
 (SELECT supplier_id FROM act WHERE action = 'CHANGE') THEN '2001-11-30' ELSE "end" END AS "end",
 current AND supplier_id NOT IN (SELECT supplier_id FROM act WHERE action = 'CHANGE') AS current FROM dim
 UNION ALL SELECT (SELECT max(sk) FROM dim) + row_number() OVER (ORDER BY supplier_id), supplier_id, name, nation, '2001-12-01', NULL, TRUE
 FROM act WHERE action <> 'SAME'""",
    "scd2_actions": f"WITH {DIM} SELECT supplier_id, action FROM act",
    "versions": f"WITH {VERSIONS} SELECT {VER_COLS} FROM ver",
    "as_of": f"WITH {VERSIONS} SELECT {VER_COLS} FROM ver WHERE valid_from <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00')",
    "between": f"WITH {VERSIONS} SELECT {VER_COLS} FROM ver WHERE valid_from <= TIMESTAMP '2024-01-12' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10')",
    "from_to": f"WITH {VERSIONS} SELECT {VER_COLS} FROM ver WHERE valid_from < TIMESTAMP '2024-01-12' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10')",
    "contained_in": f"WITH {VERSIONS} SELECT {VER_COLS} FROM ver WHERE valid_from >= TIMESTAMP '2024-01-10' AND valid_to <= TIMESTAMP '2024-01-12'",
    "version_report": f"""WITH {VERSIONS} SELECT {VER_COLS}, CASE WHEN valid_to IS NULL THEN 'CURRENT' ELSE 'HISTORIC' END AS status,
 date_diff('day', valid_from, coalesce(valid_to, TIMESTAMP '2024-01-31')) AS days_in_force FROM ver
 WHERE (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-05') AND valid_from <= TIMESTAMP '2024-01-20'""",
    "trim_history": f"WITH {VERSIONS} SELECT {VER_COLS} FROM ver WHERE valid_to IS NULL OR valid_to >= TIMESTAMP '2024-01-16'",
    "audit_diff": f"""WITH {PARTS}, j AS (SELECT coalesce(o.part_id, n.part_id) AS id,
 '{{"part_id":' || o.part_id || ',"name":"' || o.name || '"' || CASE WHEN o.brand IS NULL THEN '' ELSE ',"brand":"' || o.brand || '"' END
  || ',"price":' || CAST(o.price AS VARCHAR) || '}}' AS before,
 '{{"part_id":' || n.part_id || ',"name":"' || n.name || '"' || CASE WHEN n.brand IS NULL THEN '' ELSE ',"brand":"' || n.brand || '"' END
  || ',"price":' || CAST(n.price AS VARCHAR) || '}}' AS after FROM old o FULL JOIN new n ON o.part_id = n.part_id)
 SELECT CASE WHEN before IS NULL THEN 'I' WHEN after IS NULL THEN 'D' ELSE 'U' END AS op, 'part' AS "table", CAST(id AS VARCHAR) AS key, before, after
 FROM j WHERE before IS DISTINCT FROM after""",
    "audit_column": f"""{STAR}, n AS (SELECT account_id, sum(CASE WHEN type = 'A' THEN amount ELSE -amount END) AS net FROM tx GROUP BY 1)
 SELECT account_id, CAST(balance AS DOUBLE) AS old_value, CAST(balance + net AS DOUBLE) AS new_value, CAST(net AS DOUBLE) AS difference,
 '{{"old_value":' || CAST(balance AS VARCHAR) || ',"new_value":' || CAST(CAST(balance + net AS DECIMAL(18,2)) AS VARCHAR) || ',"difference":' || CAST(CAST(net AS DECIMAL(18,2)) AS VARCHAR) || '}}' AS record
 FROM acc JOIN n USING (account_id) WHERE net <> 0""",
    "record_history": f"""{EVENT_AUDIT} SELECT op, 'account' AS "table", key, CASE WHEN op = 'U' THEN {_IMAGE.format('old_kind', 'old_cents')} END AS before,
 {_IMAGE.format('kind', 'cents')} AS after, ts, event_id, CASE op WHEN 'I' THEN 'Insert' ELSE 'Update' END AS operation FROM a WHERE key IN {RECORDS}""",
    "field_changes": f"""{EVENT_AUDIT}, f AS (SELECT event_id, key, op, ts, 'kind' AS field, old_kind AS old_value, kind AS new_value FROM a
 UNION ALL SELECT event_id, key, op, ts, 'cents', CAST(old_cents AS VARCHAR), CAST(cents AS VARCHAR) FROM a) SELECT * FROM f WHERE old_value IS DISTINCT FROM new_value""",
    "changes_between": f"""WITH {FEED} SELECT feed.seq, CAST(op AS BIGINT) AS op, key, kind, CAST(amount AS DOUBLE) AS amount,
 CASE op WHEN 1 THEN 'DELETE' WHEN 2 THEN 'INSERT' WHEN 3 THEN 'UPDATE BEFORE' ELSE 'UPDATE AFTER' END AS operation
 FROM feed WHERE seq BETWEEN (SELECT min(event_id) FROM events WHERE ts >= TIMESTAMP '2024-01-10') AND (SELECT max(event_id) FROM events WHERE ts <= TIMESTAMP '2024-01-12')""",
    "all_changes": f"""WITH {FEED} SELECT seq, CAST(op AS BIGINT) AS op, key, kind, CAST(amount AS DOUBLE) AS amount, CASE op WHEN 1 THEN 'DELETE' WHEN 2 THEN 'INSERT'
 WHEN 3 THEN 'UPDATE BEFORE' ELSE 'UPDATE AFTER' END AS operation FROM feed WHERE seq BETWEEN 500 AND 4000""",
    "net_changes": f"WITH {FEED}, {NET} SELECT CAST(op AS BIGINT) AS op, key, seq, kind, CAST(amount AS DOUBLE) AS amount FROM net WHERE op IS NOT NULL",
    "clean_import": f"""WITH {DIRTY} SELECT id, date_text, amount_text, qty_text, email_text, d AS date_text_value, CAST(a AS DOUBLE) AS amount_text_value,
 CAST(q AS BIGINT) AS qty_text_value, CASE WHEN email_text LIKE '%@%.%' THEN email_text END AS email_text_value, status FROM clean""",
    "error_summary": f"WITH {DIRTY} SELECT status, count(*) AS rows FROM clean GROUP BY 1",
    "error_share": f"WITH {DIRTY} SELECT count(*) AS rows, count(*) FILTER (status <> 'OK') AS bad, round(count(*) FILTER (status <> 'OK') * 100.0::DOUBLE / count(*), 4) AS bad_pct FROM clean",
    "parse_by_country": """SELECT o_orderkey AS id, ['ES', 'US', 'MX', 'DE'][o_orderkey % 4 + 1] AS country,
 CASE WHEN o_orderkey % 29 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day,
 CASE WHEN o_orderkey % 29 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(10,2)) AS DOUBLE) END AS amount,
 CASE WHEN o_orderkey % 29 = 0 THEN 'ERROR' ELSE 'OK' END AS status FROM orders""",
    "conversion_by_country": """SELECT ['ES', 'US', 'MX', 'DE'][o_orderkey % 4 + 1] AS country, count(*) AS total,
 count(*) FILTER (o_orderkey % 29 <> 0) AS succeeded, count(*) FILTER (o_orderkey % 29 = 0) AS failed FROM orders GROUP BY 1""",
    "valid_rows": f"""{STAR} SELECT account_id, {_LINE}, part_id, supplier_id, CAST(tx.amount - 2000 AS DOUBLE) AS amount, ts FROM tx
 WHERE tx.amount - 2000 > 0 AND ts <= DATE '2001-06-01' AND account_id IN (SELECT account_id FROM acc WHERE state <> 'P')""",
    "rejected_rows": f"""{STAR}, r AS (SELECT account_id, {_LINE}, part_id, supplier_id, CAST(tx.amount - 2000 AS DOUBLE) AS amount, ts,
 CASE WHEN tx.amount - 2000 <= 0 THEN 'NOT_POSITIVE' WHEN ts > DATE '2001-06-01' THEN 'FUTURE'
 WHEN account_id NOT IN (SELECT account_id FROM acc WHERE state <> 'P') THEN 'NO_ACCOUNT' END AS reason FROM tx) SELECT * FROM r WHERE reason IS NOT NULL""",
    "orphans": f"{STAR} SELECT {TX_COLS} FROM tx WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.account_id = tx.account_id AND acc.state = 'O')",
    "dup_keys": "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "profile_types": " UNION ALL ".join(
        f"""SELECT '{c}' AS column, '{t}' AS type, count(*) FILTER ({c} IS NULL) AS nulls, CAST(max(abs({c})) AS DOUBLE) AS largest,
 CASE WHEN max(abs({c}) - floor(abs({c}))) > 0 THEN 'decimal(18,2)' WHEN max(abs({c})) <= 32767 THEN 'smallint' WHEN max(abs({c})) <= 2147483647 THEN 'int' ELSE 'bigint' END AS proposed,
 CAST(CASE WHEN max(abs({c}) - floor(abs({c}))) > 0 THEN 8 WHEN max(abs({c})) <= 32767 THEN 2 WHEN max(abs({c})) <= 2147483647 THEN 4 ELSE 8 END AS BIGINT) AS bytes FROM lineitem"""
        for c, t in [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"),
                     ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double")]) + "".join(
        f""" UNION ALL SELECT '{c}', 'string', count(*) FILTER ({c} IS NULL), CAST(max(length({c})) AS DOUBLE), 'varchar(' || max(length({c})) || ')', max(length({c})) FROM lineitem"""
        for c in ("l_returnflag", "l_linestatus")) + """ UNION ALL SELECT 'l_shipdate', 'timestamp_ntz', count(*) FILTER (l_shipdate IS NULL),
 CAST(max(length(CAST(l_shipdate AS VARCHAR))) AS DOUBLE), 'timestamp_ntz', 8 FROM lineitem""",
    "validate_transfers": f"WITH {TRANSFERS} SELECT source, dest, CAST(amount AS DOUBLE) AS amount, {_LINE}, supplier_id, CAST(code AS BIGINT) AS code FROM val",
    "validate_deposits": """WITH la AS (SELECT o_orderkey AS account_id, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS state FROM orders),
 r AS (SELECT l_orderkey AS account_id, l_partkey AS part_id, CAST(l_linenumber AS BIGINT) AS line,
 CAST(CASE WHEN l_quantity = 3 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount, ['CASH', 'CHEQUE', 'OTHER'][l_partkey % 3 + 1] AS origin FROM lineitem)
 SELECT account_id, part_id, line, CAST(amount AS DOUBLE) AS amount, origin, CASE WHEN r.amount <= 0 THEN 'AMOUNT' WHEN origin = 'OTHER' THEN 'ORIGIN'
 WHEN origin = 'CASH' AND r.amount > 50000 THEN 'NEEDS_APPROVAL' WHEN la.state IS NULL THEN 'UNKNOWN_ACCOUNT' WHEN la.state <> 'ACTIVE' THEN 'NOT_ACTIVE'
 ELSE 'OK' END AS status FROM r LEFT JOIN la USING (account_id)""",
    "apply_postings": f"""WITH RECURSIVE {POSTED}, n AS (SELECT id, sum(c) AS net FROM (SELECT source AS id, -amount AS c FROM posted WHERE code IS NULL
 UNION ALL SELECT dest, amount FROM posted WHERE code IS NULL) GROUP BY 1) SELECT account_id, state, type, CAST(balance + coalesce(net, 0) AS DOUBLE) AS balance
 FROM la LEFT JOIN n ON id = account_id""",
    "post_transfers": f"WITH RECURSIVE {POSTED} SELECT source, dest, CAST(amount AS DOUBLE) AS amount, line, supplier_id, CAST(code AS BIGINT) AS code FROM posted",
    "post_withdrawals": """WITH RECURSIVE req AS (SELECT l_suppkey AS account_id, strftime(l_shipdate, '%Y-%m-01') AS day, l_shipdate AS ts, l_orderkey AS order_id,
 CAST(l_linenumber AS BIGINT) AS line, l_partkey AS part_id, CAST(round(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * 100 AS BIGINT) / 10.0) AS BIGINT) AS cents,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem),
 walk AS (SELECT s_suppkey AS account_id, CAST(0 AS BIGINT) AS rn, ((s_suppkey % 5) * 100000 + 90000) * 100 AS funds, '' AS day, CAST(0 AS BIGINT) AS used, FALSE AS ok
 FROM supplier WHERE s_suppkey % 8 <> 7
 UNION ALL SELECT w.account_id, r.rn, w.funds - CASE WHEN r.cents <= w.funds AND r.cents + CASE WHEN r.day = w.day THEN w.used ELSE 0 END <= 1000000 THEN r.cents ELSE 0 END,
 r.day, CASE WHEN r.day = w.day THEN w.used ELSE 0 END + CASE WHEN r.cents <= w.funds AND r.cents + CASE WHEN r.day = w.day THEN w.used ELSE 0 END <= 1000000 THEN r.cents ELSE 0 END,
 r.cents <= w.funds AND r.cents + CASE WHEN r.day = w.day THEN w.used ELSE 0 END <= 1000000 FROM walk w JOIN req r ON r.account_id = w.account_id AND r.rn = w.rn + 1)
 SELECT r.account_id, r.day, r.ts, r.order_id, r.line, r.part_id, r.cents / 100 AS amount,
 CASE WHEN r.account_id % 8 = 7 THEN 'NOT_ACTIVE' WHEN w.ok THEN 'ACCEPTED' ELSE 'LIMIT' END AS status
 FROM req r LEFT JOIN walk w ON w.account_id = r.account_id AND w.rn = r.rn""",
    "spread_amount": f"""WITH {TRANSFERS}, o AS (SELECT account_id, row_number() OVER (ORDER BY account_id) AS rn, count(*) OVER () AS n FROM la
 WHERE state = 'ACTIVE' AND account_id <> 1) SELECT account_id, state, type, round(CAST(balance AS DOUBLE) + CASE WHEN account_id = 1 THEN -12345.67
 WHEN rn IS NULL THEN 0 ELSE (1234567 // n + CASE WHEN rn <= 1234567 % n THEN 1 ELSE 0 END) / 100 END, 2) AS balance FROM la LEFT JOIN o USING (account_id)""",
    "interest": f"""{STAR}, i AS (SELECT *, CAST((2 * CAST(acc.balance * 100 AS BIGINT) * CASE type WHEN '1-URGENT' THEN 25000 WHEN '2-HIGH' THEN 10000
 WHEN '5-LOW' THEN 45000 ELSE 0 END + 365000000) // 730000000 AS BIGINT) AS cents FROM acc)
 SELECT account_id, client_id, state, type, CAST(i.balance AS DOUBLE) AS balance, opened, cents / 100 AS interest,
 CAST(CAST(i.balance * 100 AS BIGINT) + cents AS DOUBLE) / 100 AS new_balance FROM i""",
    "commissions": f"""{STAR} SELECT {TX_COLS}, CAST(CASE type WHEN 'R' THEN tx.amount * 0.01 WHEN 'N' THEN CASE WHEN tx.amount > 10000 THEN 50 ELSE 25 END
 WHEN 'A' THEN tx.amount * 0.005 END AS DECIMAL(18,4))::DOUBLE AS commission FROM tx WHERE ts >= DATE '1998-01-01' AND ts < DATE '1998-04-01' AND state = 'F'""",
    "low_balance": f"""{STAR} SELECT account_id, client_id, CAST(acc.balance - 60000 AS DOUBLE) AS balance, CASE WHEN acc.balance < 60000 THEN 'OVERDRAWN' ELSE 'LOW' END AS alert
 FROM acc WHERE acc.balance - 60000 < 1000""",
    "block_negative": f"""{STAR} SELECT account_id, client_id, CASE WHEN acc.balance < 60000 AND opened < DATE '2001-12-01' - INTERVAL 300 DAY THEN 'BLOCKED' ELSE state END AS state,
 type, CAST(acc.balance - 60000 AS DOUBLE) AS balance, opened FROM acc""",
    "close_day": f"""{STAR} SELECT type, count(*) AS tx_count, CAST(sum(tx.amount) AS DOUBLE) AS amount, round(CAST(sum(tx.amount) AS DOUBLE) / count(*), 4) AS average,
 round(CAST(sum(tx.amount) AS DOUBLE) * 100.0 / CAST(sum(sum(tx.amount)) OVER () AS DOUBLE), 4) AS amount_pct,
 round(CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS count_pct
 FROM tx WHERE ts = DATE '1998-03-02' AND state IN ('F', 'O') GROUP BY type""",
    "close_day_rows": f"{STAR} SELECT account_id, {_LINE}, part_id, supplier_id, type, CASE WHEN ts = DATE '1998-03-02' AND state = 'O' THEN 'F' ELSE state END AS state, CAST(tx.amount AS DOUBLE) AS amount, ts FROM tx",
    "reconcile": f"""{STAR}, n AS (SELECT account_id, sum(CASE WHEN type = 'A' THEN amount ELSE -amount END) AS net FROM tx GROUP BY 1)
 SELECT account_id, CAST(balance AS DOUBLE) AS balance, CAST(coalesce(net, 0) AS DOUBLE) AS moved, CAST(balance - coalesce(net, 0) AS DOUBLE) AS difference
 FROM acc LEFT JOIN n USING (account_id) WHERE balance - coalesce(net, 0) <> 0""",
}
