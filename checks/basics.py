"""Scans, predicates, joins, aggregations, windows, pages, reshaping and search."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.common import AS_OF, on_bank, on_tables
from checks.reports import STAR
from ledgerkit.functions import exprs as x
from ledgerkit.functions import predicates as p
from ledgerkit.operators import aggs, govern, joins, ordered, paging, reshape, search
from ledgerkit.plans import reports
from ledgerkit.plans.reports import balances, per_client
from ledgerkit.session import settle
from ledgerkit.sources import bank as views
from ledgerkit.sources import generate as g
from ledgerkit.sources.readers import load, rows_by_key, table_counts

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
BY_TIME = ["ts", "account_id", "line", "part_id", "supplier_id"]
TX_COLS = """account_id, CAST(line AS BIGINT) AS line, part_id, supplier_id, type, state,
 CAST(tx.amount AS DOUBLE) AS amount, ts"""
ACC_COLS = "account_id, client_id, state, type, CAST(acc.balance AS DOUBLE) AS balance, opened"
HOLIDAYS = {"01-01": "New Year", "05-01": "Labour Day", "12-25": "Christmas"}


def totals(b):
    return per_client(b, b.tx, F.sum("amount").alias("amount"))


def client_ranks(b):
    rows = settle(totals(b))
    out = ordered.with_ntile(rows, [], ["-amount", "client_id"], 4, "quartile")
    return ordered.with_ranks(out, [], "-amount", "rank", "dense", "percent", source=rows)


def scalar_subquery(b):
    per = b.tx.groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("moved"))
    joined = b.accounts.select("account_id", "balance").join(per, "account_id", "left")
    mean = b.accounts.agg((F.sum("balance").cast("double") / F.count(F.lit(1))).alias("m")).scalar()
    return joined.filter(F.col("balance").cast("double") > mean).fillna(0, ["n", "moved"])


def org(spark, folder):
    """Regions, their nations and the suppliers there as one parent/child table."""
    region = load(spark, folder, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    nation = load(spark, folder, "nation").select(
        F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    supplier = load(spark, folder, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    return region.unionByName(nation).unionByName(supplier)


def detail(spark, folder):
    """Line items with the nation of the client and, the same table again, of the supplier."""
    star = joins.bank_star(views.bank(spark, folder)).drop("name")
    supplier = load(spark, folder, "supplier", ["s_suppkey", "s_nationkey"])
    nation = load(spark, folder, "nation", ["n_nationkey", "n_name"])
    return joins.with_lookups(star, [
        (supplier, "supplier_id", "s_suppkey", "to_"), (nation, "branch_id", "n_nationkey", "from_"),
        (nation, "to_s_nationkey", "n_nationkey", "dest_"),
    ]).select("account_id", "line", "part_id", "supplier_id", "from_n_name", "dest_n_name", "amount")


def text_functions(spark, folder):
    name = F.col("c_name")
    return load(spark, folder, "customer").select(
        "c_custkey", F.left(name, F.lit(8)).alias("head"), x.zero_pad("c_custkey", 10).alias("padded"),
        x.stuff("c_name", 1, 8, "Cli").alias("stuffed"), F.upper(name).alias("shout"),
        x.text_len(F.concat(name, F.lit("   "))).alias("len"),
        F.substring("c_mktsegment", 2, 3).alias("middle"), F.replace(name, F.lit("#"), F.lit("-")).alias("dashed"),
        x.concat_skip_null("c_mktsegment", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("joined"),
    )


def date_functions(spark, folder):
    day, end = F.col("o_orderdate"), F.lit(AS_OF).cast("timestamp_ntz")
    return load(spark, folder, "orders").select(
        "o_orderkey", F.year(day).alias("y"), F.quarter(day).alias("q"), x.week_number(day).alias("week"),
        F.dayofweek(day).alias("weekday"), x.day_name(day).alias("day_name"),
        x.month_name(day).alias("month_name"), F.last_day(day).alias("month_end"),
        x.date_diff("day", day, end).alias("days"), x.date_diff("month", day, end).alias("months"),
        x.date_diff("year", day, end).alias("years"), x.date_diff("week", day, end).alias("weeks"),
        F.date_format(day, "dd/MM/yyyy").alias("shown"),
        F.make_date(F.year(day), F.month(day), F.lit(1)).alias("month_start"),
        F.add_months(F.to_date(day), -1).alias("month_before"),
    )


def math_functions(spark, folder):
    v = F.col("l_extendedprice").cast("decimal(18,2)")
    return load(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.abs(v - 30000).alias("distance"), F.ceil(v / 1000).cast("long").alias("thousands"),
        (F.col("l_orderkey") % 7).alias("bucket"), F.power(F.col("l_linenumber").cast("double"), F.lit(2.0)).alias("squared"),
        x.safe_div(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("ratio"),
        F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit("-")).alias("flag"),
    )


QUERIES = {
    "table_counts": on_tables(lambda s, d: table_counts({n: load(s, d, n) for n in TABLES})),
    "seek_range": on_tables(lambda s, d: rows_by_key(load(s, d, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", 1000, 5000)),
    "range_year": on_bank(lambda b: b.tx.filter(p.in_year("ts", 1998) & F.col("state").isin("F", "O"))),
    "range_month_open": on_bank(lambda b: b.tx.filter(p.in_month("ts", 1998, 6) & (F.col("state") != "F"))),
    "last_90_days": on_bank(lambda b: b.tx.filter(p.last("ts", 90, "day", AS_OF))),
    "like_prefix": on_tables(lambda s, d: p.like_filter(load(s, d, "part", ["p_partkey", "p_name", "p_type"]), "p_type", "%MALL%")),
    "null_or_eq": on_bank(lambda b: totals(b).join(b.clients, "client_id", "right").filter(p.null_or_eq("branch_id", 3))
                          .select("client_id", "branch_id", "amount")),
    "moved_predicates": on_bank(lambda b: b.accounts.filter(
        p.added_days_at_least("opened", 30, "2000-01-01") & p.plus_greater("balance", 1000, 50000)
        & p.prefix_is("type", "1-") & p.days_since_at_most("opened", 600, AS_OF))),
    "business_days": on_tables(lambda s, d: g.business_days(
        views.transactions(s, d), "ts", g.date_dim(s, date(1995, 1, 1), date(2001, 12, 31), HOLIDAYS), 1998, 5)),
    "tiers": on_bank(lambda b: b.accounts.select(
        "account_id", x.tier("balance", [(200000, "high"), (100000, "middle")], "low").alias("tier"),
        F.when(F.col("state") == "F", "closed").when(F.col("state") == "O", "open").otherwise("pending").alias("state"))),
    "text_functions": on_tables(text_functions),
    "date_functions": on_tables(date_functions),
    "math_functions": on_tables(math_functions),
    "star_join": on_bank(lambda b: joins.bank_star(b).filter(F.col("segment") == "BUILDING")
                         .select("account_id", "line", "part_id", "supplier_id", "client_id", "name", "account_type", "amount")),
    "left_in_period": on_bank(lambda b: joins.left_in_period(
        b.accounts.select("account_id", "balance"), b.tx.select("account_id", "amount", "ts"), "account_id", p.in_year("ts", 1999))),
    "transaction_detail": on_tables(detail),
    "semi_accounts": on_bank(lambda b: joins.having_any(b.accounts, b.tx.filter(F.col("amount") > 50000), "account_id")),
    "semi_by_join": on_bank(lambda b: joins.having_any_by_join(b.accounts, b.tx.filter(F.col("amount") > 50000), "account_id")),
    "anti_accounts": on_bank(lambda b: joins.without_any(b.accounts, b.tx, "account_id")),
    "not_in": on_bank(lambda b: joins.not_in(b.accounts, "account_id", b.tx.filter(F.col("type") == "R"), "account_id")),
    "is_in": on_bank(lambda b: joins.is_in(b.accounts, "account_id", b.tx.filter(p.in_month("ts", 1998, 2)), "account_id")),
    "duplicate_pairs": on_bank(lambda b: joins.duplicate_pairs(b.accounts, ["client_id", "opened"], "account_id")),
    "prefix_pairs": on_tables(lambda s, d: joins.prefix_pairs(
        load(s, d, "part", ["p_name"]).unionByName(load(s, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("p_name"))), "p_name", " ")),
    "top3_per_client": on_bank(lambda b: joins.top_n_per(
        b.clients.select("client_id", "name"), b.accounts.select("client_id", "account_id", "balance"),
        "client_id", ["-balance", "account_id"], 3)),
    "top_apply_outer": on_bank(lambda b: joins.top_n_per(
        b.accounts.select("account_id"), b.tx.filter(p.in_year("ts", 2001)).select("account_id", "amount", "ts", "line", "part_id", "supplier_id"),
        "account_id", ["-ts", "line", "part_id", "supplier_id"], 2, outer=True)),
    "join_by_ids": on_bank(lambda b: joins.by_ids(b.accounts, b.clients.filter("branch_id = 5"), "client_id")),
    "hinted_join_merge": on_bank(lambda b: joins.hinted_join(
        b.accounts.select("account_id", "client_id"), b.clients.select("client_id", "segment"), "client_id", "merge")),
    "hinted_join_loop": on_bank(lambda b: joins.hinted_join(
        b.accounts.select("account_id", "client_id"), b.clients.select("client_id", "segment"), "client_id", "loop")),
    "like_starts": on_tables(lambda s, d: p.like_filter(load(s, d, "part", ["p_partkey", "p_name", "p_type"]), "p_type", "SMALL%")),
    "like_ends": on_tables(lambda s, d: p.like_filter(load(s, d, "part", ["p_partkey", "p_name", "p_type"]), "p_type", "%STEEL")),
    "hinted_join": on_bank(lambda b: joins.hinted_join(
        b.accounts.select("account_id", "client_id"), b.clients.select("client_id", "segment"), "client_id", "hash")),
    "hierarchy": on_tables(lambda s, d: joins.hierarchy(org(s, d), "id", "parent")),
    "scalar_subquery": on_bank(scalar_subquery),
    "count_distinct": on_bank(lambda b: b.tx.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("account_id").alias("accounts"),
        F.count_distinct("part_id").alias("parts"), F.sum_distinct("line").alias("lines"))),
    "deviation": on_tables(lambda s, d: load(s, d, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("deviation"))),
    "by_weekday": on_tables(lambda s, d: aggs.by_period(load(s, d, "events"), "ts", "weekday", F.count(F.lit(1)).alias("n"))),
    "share_of_total": on_bank(lambda b: aggs.share_of_total(b.tx, ["type", "state"], "amount")),
    "percentiles": on_tables(lambda s, d: aggs.latency_percentiles(load(s, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])),
    "percentiles_all": on_bank(lambda b: aggs.latency_percentiles(b.tx, [], "amount", [0.5, 0.95, 0.99])),
    "string_agg": on_tables(lambda s, d: aggs.string_agg(load(s, d, "events"), ["user_id"], "event_type", ", ", distinct=True)),
    "ordered_items": on_bank(lambda b: aggs.ordered_items(b.accounts, ["client_id"], "account_id")),
    "accounts_with_counts": on_bank(lambda b: reports.accounts_with_counts(b, "2-HIGH")),
    "accounts_with_counts_all": on_bank(reports.accounts_with_counts),
    "string_agg_all": on_bank(lambda b: aggs.string_agg(b.accounts, ["client_id"], "account_id", ";")),
    "avg_last5": on_tables(lambda s, d: aggs.avg_last_n(
        load(s, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)")), ["user_id"], ["ts", "event_id"], "value", 5)),
    "number_rows": on_bank(lambda b: ordered.number_rows(b.tx, [], BY_TIME, "rn")),
    "running_balance": on_bank(lambda b: ordered.with_running(
        b.tx, ["account_id"], ["ts", "line", "part_id", "supplier_id"],
        {"running": F.when(F.col("type") == "A", F.col("amount")).otherwise(-F.col("amount"))})),
    "running_by_part": on_bank(lambda b: ordered.with_running(
        b.tx.select("part_id", "ts", "account_id", "line", "supplier_id", "amount"), ["part_id"],
        ["-ts", "account_id", "line", "supplier_id"], {"remaining": F.col("amount"), "n": F.lit(1).cast("long")})),
    "client_ranks": on_bank(client_ranks),
    "lag_lead": on_bank(lambda b: ordered.led(
        ordered.lagged(b.accounts, ["client_id"], ["opened", "account_id"], {"before": "balance"}),
        ["client_id"], ["opened", "account_id"], {"after": "balance"}).withColumn(
            "change", F.col("balance") - F.coalesce("before", "balance"))),
    "first_last": on_bank(lambda b: ordered.first_last(b.accounts, ["client_id"], ["opened", "account_id"], "balance")),
    "moving_avg": on_bank(lambda b: ordered.moving(
        b.accounts, ["client_id"], ["opened", "account_id"], 3, {"moved": F.sum("balance"), "used": F.count("balance")})),
    "latest": on_bank(lambda b: ordered.latest(b.accounts, ["client_id"], ["opened", "account_id"])),
    "top_accounts": on_bank(lambda b: paging.top_n(b.accounts, 50, "-balance", "account_id")),
    "page": on_bank(lambda b: paging.page(b.tx, BY_TIME, 3, 25)),
    "page_deep": on_bank(lambda b: paging.page(b.tx, BY_TIME, 500, 25)),
    "next_batch": on_bank(lambda b: paging.next_batch(b.accounts, "account_id", 2500, 100)),
    "pivot_month": on_bank(lambda b: reshape.pivot_by_month(b.tx, ["type"], 1998)),
    "pivot_type": on_bank(lambda b: reshape.pivot_by_type(b.tx, "1998-01-01", "1999-01-01")),
    "unpivot": on_bank(lambda b: reshape.to_attributes(
        b.clients.withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING"))), ["client_id"], ["name", "segment", "branch_id"])),
    "search_table": on_tables(lambda s, d: search.search(
        {"orders": load(s, d, "orders")}, "orders", "o_orderstatus", "P", "o_orderkey", False, 30)),
    "search_field": on_bank(lambda b: search.search_field(b.clients, {"name": "name", "segment": "segment"}, "name", "12")),
    "search_clients": on_bank(lambda b: search.search_clients(b, name="1", segment="MACHINERY", min_credit=1000, max_balance=2500000)),
    "search_accounts": on_bank(lambda b: search.search_accounts(b, state="O", min_balance=200000, opened_from="1998-01-01", opened_to="1998-12-31")),
    "search_transactions": on_bank(lambda b: search.search_transactions(b, "A, R", "1998-01-01", "1998-03-31", min_amount=60000)),
    "search_page": on_bank(lambda b: search.search_page(b, 2, 15, "balance", segment="BUILDING", min_balance=100000)),
    "count_where": on_tables(lambda s, d: search.count_where({"lineitem": load(s, d, "lineitem")}, "lineitem", "l_returnflag", "R")),
    "client_accounts": on_bank(lambda b: search.client_accounts(b, show_balance=True, show_count=True, show_last=True)),
    "mask": on_bank(lambda b: govern.mask(b.clients.withColumn("email", F.concat("name", F.lit("@bank.example"))),
                                          {"name": "partial(0,****,4)", "email": "email", "segment": "default"})),
    "rows_for": on_bank(lambda b: govern.rows_for(b.clients, "branch_id", [3, 7])),
    "list_items": on_tables(lambda s, d: load(s, d, "part").select("p_partkey", F.explode(x.items("p_name", " ")).alias("word"))),
    "date_dim": on_tables(lambda s, d: load(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
                          .agg(F.count(F.lit(1)).alias("opened")).join(
                              g.date_dim(s, date(1995, 1, 1), date(2001, 12, 31), HOLIDAYS), "date")),
    "days_without_orders": on_tables(lambda s, d: joins.without_any(
        g.days(s, date(1995, 1, 1), date(2001, 8, 1)), load(s, d, "orders").select(F.to_date("o_orderdate").alias("date")), "date")),
}

_OPENED = "PARTITION BY client_id ORDER BY opened, account_id"

SQL = {
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES),
    "seek_range": "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 5000",
    "range_year": f"{STAR} SELECT {TX_COLS} FROM tx WHERE year(ts) = 1998 AND state IN ('F', 'O')",
    "range_month_open": f"{STAR} SELECT {TX_COLS} FROM tx WHERE year(ts) = 1998 AND month(ts) = 6 AND state <> 'F'",
    "last_90_days": f"{STAR} SELECT {TX_COLS} FROM tx WHERE ts >= DATE '2001-12-01' - INTERVAL 90 DAY AND ts <= DATE '2001-12-01'",
    "like_prefix": "SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%MALL%'",
    "null_or_eq": f"""{STAR} SELECT client_id, CAST(branch_id AS BIGINT) AS branch_id, CAST(sum(tx.amount) AS DOUBLE) AS amount
 FROM cli LEFT JOIN (SELECT account_id, client_id FROM acc) USING (client_id) LEFT JOIN tx USING (account_id)
 WHERE coalesce(branch_id, 3) = 3 GROUP BY 1, 2""",
    "moved_predicates": f"""{STAR} SELECT {ACC_COLS} FROM acc WHERE opened + INTERVAL 30 DAY >= DATE '2000-01-01'
 AND acc.balance + 1000 > 50000 AND left(type, 2) = '1-' AND date_diff('day', opened, DATE '2001-12-01') <= 600""",
    "business_days": f"""{STAR} SELECT {TX_COLS} FROM tx WHERE year(ts) = 1998 AND month(ts) = 5
 AND dayofweek(ts) NOT IN (0, 6) AND strftime(ts, '%m-%d') <> '05-01'""",
    "tiers": f"""{STAR} SELECT account_id, CASE WHEN balance >= 200000 THEN 'high' WHEN balance >= 100000 THEN 'middle'
 ELSE 'low' END AS tier, CASE acc.state WHEN 'F' THEN 'closed' WHEN 'O' THEN 'open' ELSE 'pending' END AS state FROM acc""",
    "text_functions": """SELECT c_custkey, left(c_name, 8) AS head, right('0000000000' || c_custkey, 10) AS padded,
 'Cli' || substr(c_name, 9) AS stuffed, upper(c_name) AS shout, length(c_name) AS len, substr(c_mktsegment, 2, 3) AS middle,
 replace(c_name, '#', '-') AS dashed, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment
 ELSE c_mktsegment || c_mktsegment END AS joined FROM customer""",
    "date_functions": """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q,
 CAST(floor((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) - 1) / 7) + 1 AS BIGINT) AS week,
 dayofweek(o_orderdate) + 1 AS weekday, dayname(o_orderdate) AS day_name, monthname(o_orderdate) AS month_name,
 strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end,
 date_diff('day', o_orderdate, TIMESTAMP '2001-12-01') AS days, date_diff('month', o_orderdate, TIMESTAMP '2001-12-01') AS months,
 date_diff('year', o_orderdate, TIMESTAMP '2001-12-01') AS years,
 date_diff('week', o_orderdate + INTERVAL 1 DAY, TIMESTAMP '2001-12-02') AS weeks,
 strftime(o_orderdate, '%d/%m/%Y') AS shown, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start,
 strftime(o_orderdate - INTERVAL 1 MONTH, '%Y-%m-%d') AS month_before FROM orders""",
    "math_functions": """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
 CAST(abs(CAST(l_extendedprice AS DECIMAL(18,2)) - 30000) AS DOUBLE) AS distance,
 CAST(ceil(CAST(l_extendedprice AS DECIMAL(18,2)) / 1000) AS BIGINT) AS thousands, l_orderkey % 7 AS bucket,
 CAST(l_linenumber * l_linenumber AS DOUBLE) AS squared,
 CASE WHEN l_linenumber > 1 THEN round(l_quantity / (l_linenumber - 1), 4) END AS ratio,
 coalesce(nullif(l_returnflag, 'N'), '-') AS flag FROM lineitem""",
    "star_join": f"""{STAR} SELECT account_id, CAST(line AS BIGINT) AS line, part_id, supplier_id, client_id, name,
 acc.type AS account_type, CAST(amount AS DOUBLE) AS amount FROM tx JOIN acc USING (account_id) JOIN cli USING (client_id)
 WHERE segment = 'BUILDING'""",
    "left_in_period": f"""{STAR} SELECT account_id, CAST(balance AS DOUBLE) AS balance, CAST(amount AS DOUBLE) AS amount, ts
 FROM acc LEFT JOIN tx ON acc.account_id = tx.account_id AND year(ts) = 1999""".replace("SELECT account_id, CAST(balance", "SELECT acc.account_id AS account_id, CAST(balance"),
    "transaction_detail": f"""{STAR} SELECT account_id, CAST(line AS BIGINT) AS line, part_id, supplier_id,
 n1.n_name AS from_n_name, n2.n_name AS dest_n_name, CAST(amount AS DOUBLE) AS amount
 FROM tx JOIN acc USING (account_id) JOIN cli USING (client_id) LEFT JOIN supplier ON s_suppkey = supplier_id
 LEFT JOIN nation n1 ON n1.n_nationkey = branch_id LEFT JOIN nation n2 ON n2.n_nationkey = s_nationkey""",
    "semi_accounts": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE EXISTS (SELECT 1 FROM tx WHERE tx.account_id = acc.account_id AND amount > 50000)",
    "semi_by_join": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE account_id IN (SELECT account_id FROM tx WHERE amount > 50000)",
    "anti_accounts": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE NOT EXISTS (SELECT 1 FROM tx WHERE tx.account_id = acc.account_id)",
    "not_in": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE account_id NOT IN (SELECT account_id FROM tx WHERE type = 'R')",
    "is_in": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE account_id IN (SELECT account_id FROM tx WHERE year(ts) = 1998 AND month(ts) = 2)",
    "duplicate_pairs": f"""{STAR} SELECT * FROM (SELECT client_id, opened, account_id AS duplicate_id,
 min(account_id) OVER w AS first_id, count(*) OVER w AS copies FROM acc WINDOW w AS (PARTITION BY client_id, opened))
 WHERE duplicate_id <> first_id""",
    "prefix_pairs": """WITH l AS (SELECT p_name AS v FROM part UNION SELECT split_part(p_name, ' ', 1) FROM part)
 SELECT a.v AS shorter, b.v AS longer FROM l a JOIN l b ON starts_with(b.v, a.v || ' ')""",
    "top3_per_client": f"""{STAR} SELECT client_id, name, account_id, CAST(a.balance AS DOUBLE) AS balance, rn FROM cli
 JOIN (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY balance DESC, account_id) AS rn FROM acc) a USING (client_id) WHERE rn <= 3""",
    "top_apply_outer": f"""{STAR}, t AS (SELECT *, row_number() OVER (PARTITION BY account_id
 ORDER BY ts DESC, line, part_id, supplier_id) AS rn FROM tx WHERE year(ts) = 2001)
 SELECT acc.account_id AS account_id, CAST(amount AS DOUBLE) AS amount, ts, CAST(line AS BIGINT) AS line, part_id, supplier_id, rn
 FROM acc LEFT JOIN t ON t.account_id = acc.account_id AND rn <= 2""",
    "join_by_ids": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE client_id IN (SELECT client_id FROM cli WHERE branch_id = 5)",
    "hinted_join_merge": f"{STAR} SELECT account_id, client_id, segment FROM acc JOIN cli USING (client_id)",
    "hinted_join_loop": f"{STAR} SELECT account_id, client_id, segment FROM acc JOIN cli USING (client_id)",
    "like_starts": "SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE 'SMALL%'",
    "like_ends": "SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%STEEL'",
    "hinted_join": f"{STAR} SELECT account_id, client_id, segment FROM acc JOIN cli USING (client_id)",
    "hierarchy": """WITH RECURSIVE org AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
 walk AS (SELECT id, id AS root, 1 AS level FROM org WHERE parent IS NULL
 UNION ALL SELECT org.id, walk.root, walk.level + 1 FROM org JOIN walk ON org.parent = walk.id)
 SELECT id, root, CAST(level AS BIGINT) AS level FROM walk""",
    "scalar_subquery": f"""{STAR} SELECT account_id, CAST(balance AS DOUBLE) AS balance,
 (SELECT count(*) FROM tx WHERE tx.account_id = acc.account_id) AS n,
 CAST(coalesce((SELECT sum(amount) FROM tx WHERE tx.account_id = acc.account_id), 0) AS DOUBLE) AS moved FROM acc
 WHERE CAST(acc.balance AS DOUBLE) > (SELECT CAST(sum(balance) AS DOUBLE) / count(*) FROM acc)""",
    "count_distinct": f"""{STAR} SELECT type, count(*) AS n, count(DISTINCT account_id) AS accounts, count(DISTINCT part_id) AS parts,
 CAST(sum(DISTINCT line) AS BIGINT) AS lines FROM tx GROUP BY type""",
    "deviation": "SELECT event_type, count(*) AS n, round(stddev_samp(value), 4) AS deviation FROM events GROUP BY 1",
    "by_weekday": "SELECT dayofweek(ts) + 1 AS weekday, count(*) AS n FROM events GROUP BY 1",
    "share_of_total": f"""{STAR} SELECT type, state, CAST(sum(amount) AS DOUBLE) AS total,
 round(CAST(sum(amount) AS DOUBLE) * 100.0 / CAST(sum(sum(amount)) OVER () AS DOUBLE), 4) AS share_pct FROM tx GROUP BY 1, 2""",
    "percentiles": """SELECT event_type, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95,
 round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1""",
    "percentiles_all": f"""{STAR} SELECT round(quantile_cont(CAST(amount AS DOUBLE), 0.5), 4) AS p50,
 round(quantile_cont(CAST(amount AS DOUBLE), 0.95), 4) AS p95, round(quantile_cont(CAST(amount AS DOUBLE), 0.99), 4) AS p99 FROM tx""",
    "string_agg": "SELECT user_id, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS items FROM events GROUP BY 1",
    "ordered_items": f"{STAR} SELECT client_id, account_id, row_number() OVER (PARTITION BY client_id ORDER BY account_id) AS position FROM acc",
    "accounts_with_counts": f"""{STAR} SELECT account_id, type, state, CAST(acc.balance AS DOUBLE) AS balance, client_id, name, segment, coalesce(n, 0) AS tx_count FROM acc
 LEFT JOIN cli USING (client_id) LEFT JOIN (SELECT account_id, count(*) AS n FROM tx GROUP BY 1) USING (account_id) WHERE type = '2-HIGH'""",
    "accounts_with_counts_all": f"""{STAR} SELECT account_id, type, state, CAST(acc.balance AS DOUBLE) AS balance, client_id, name, segment, coalesce(n, 0) AS tx_count FROM acc
 LEFT JOIN cli USING (client_id) LEFT JOIN (SELECT account_id, count(*) AS n FROM tx GROUP BY 1) USING (account_id)""",
    "string_agg_all": f"{STAR} SELECT client_id, string_agg(CAST(account_id AS VARCHAR), ';' ORDER BY account_id) AS items FROM acc GROUP BY 1",
    "avg_last5": """SELECT user_id, round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS average, count(*) AS used FROM (SELECT user_id,
 CAST(value AS DECIMAL(18,2)) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY 1""",
    "number_rows": f"{STAR} SELECT {TX_COLS}, row_number() OVER (ORDER BY ts, account_id, tx.line, part_id, supplier_id) AS rn FROM tx",
    "running_balance": f"""{STAR} SELECT {TX_COLS}, CAST(sum(CASE WHEN type = 'A' THEN tx.amount ELSE -tx.amount END) OVER (PARTITION BY account_id
 ORDER BY ts, tx.line, part_id, supplier_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM tx""",
    "running_by_part": f"""{STAR} SELECT part_id, ts, account_id, CAST(line AS BIGINT) AS line, supplier_id, CAST(tx.amount AS DOUBLE) AS amount,
 CAST(sum(tx.amount) OVER w AS DOUBLE) AS remaining, count(*) OVER w AS n FROM tx WINDOW w AS (PARTITION BY part_id
 ORDER BY ts DESC, account_id, tx.line, supplier_id ROWS UNBOUNDED PRECEDING)""",
    "client_ranks": f"""{STAR}, t AS (SELECT client_id, sum(amount) AS s FROM tx JOIN acc USING (account_id) GROUP BY 1)
 SELECT client_id, CAST(s AS DOUBLE) AS amount, rank() OVER (ORDER BY s DESC) AS rank, dense_rank() OVER (ORDER BY s DESC) AS dense,
 round(percent_rank() OVER (ORDER BY s DESC), 4) AS percent, ntile(4) OVER (ORDER BY s DESC, client_id) AS quartile FROM t""",
    "lag_lead": f"""{STAR} SELECT {ACC_COLS}, CAST(lag(acc.balance) OVER w AS DOUBLE) AS before, CAST(lead(acc.balance) OVER w AS DOUBLE) AS after,
 CAST(acc.balance - lag(acc.balance, 1, acc.balance) OVER w AS DOUBLE) AS change FROM acc WINDOW w AS ({_OPENED})""",
    "first_last": f"""{STAR} SELECT {ACC_COLS}, CAST(first_value(acc.balance) OVER w AS DOUBLE) AS first_value,
 CAST(last_value(acc.balance) OVER w AS DOUBLE) AS last_value FROM acc
 WINDOW w AS ({_OPENED} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "moving_avg": f"""{STAR} SELECT {ACC_COLS}, CAST(sum(acc.balance) OVER w AS DOUBLE) AS moved, count(*) OVER w AS used FROM acc
 WINDOW w AS ({_OPENED} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""",
    "latest": f"{STAR} SELECT {ACC_COLS} FROM acc QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY opened DESC, account_id DESC) = 1",
    "top_accounts": f"{STAR} SELECT {ACC_COLS} FROM acc ORDER BY acc.balance DESC, account_id LIMIT 50",
    "page": f"""{STAR} SELECT {TX_COLS}, CAST(3 AS BIGINT) AS page, CAST(ceil((SELECT count(*) FROM tx) / 25) AS BIGINT) AS total_pages,
 (SELECT count(*) FROM tx) AS total_rows FROM tx ORDER BY ts, account_id, tx.line, part_id, supplier_id LIMIT 25 OFFSET 50""",
    "page_deep": f"""{STAR} SELECT {TX_COLS}, CAST(500 AS BIGINT) AS page, CAST(ceil((SELECT count(*) FROM tx) / 25) AS BIGINT) AS total_pages,
 (SELECT count(*) FROM tx) AS total_rows FROM tx ORDER BY ts, account_id, tx.line, part_id, supplier_id LIMIT 25 OFFSET 12475""",
    "next_batch": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE account_id > 2500 ORDER BY account_id LIMIT 100",
    "pivot_month": f"{STAR} SELECT type, " + ", ".join(
        f"CAST(sum(amount) FILTER (month(ts) = {i + 1}) AS DOUBLE) AS {m}" for i, m in enumerate(x.MONTH_NAMES)
    ) + " FROM tx WHERE year(ts) = 1998 GROUP BY type",
    "pivot_type": f"""{STAR} SELECT account_id, CAST(sum(amount) FILTER (type = 'A') AS DOUBLE) AS A, CAST(sum(amount) FILTER (type = 'N') AS DOUBLE) AS N,
 CAST(sum(amount) FILTER (type = 'R') AS DOUBLE) AS R FROM tx WHERE year(ts) = 1998 GROUP BY 1""",
    "unpivot": """SELECT c_custkey AS client_id, 'name' AS attribute, c_name AS value FROM customer
 UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'
 UNION ALL SELECT c_custkey, 'branch_id', CAST(c_nationkey AS VARCHAR) FROM customer""",
    "search_table": """SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority
 FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey DESC LIMIT 30""",
    "search_field": f"{STAR} SELECT client_id, name, segment, CAST(branch_id AS BIGINT) AS branch_id, CAST(credit AS DOUBLE) AS credit FROM cli WHERE name LIKE '%12%'",
    "search_clients": f"""{STAR}, b AS (SELECT client_id, count(*) AS accounts, sum(balance) AS balance FROM acc GROUP BY 1)
 SELECT client_id, name, segment, CAST(branch_id AS BIGINT) AS branch_id, CAST(credit AS DOUBLE) AS credit, coalesce(accounts, 0) AS accounts,
 CAST(coalesce(b.balance, 0) AS DOUBLE) AS balance FROM cli LEFT JOIN b USING (client_id)
 WHERE name LIKE '%1%' AND segment = 'MACHINERY' AND cli.credit >= 1000 AND coalesce(b.balance, 0) <= 2500000""",
    "search_accounts": f"{STAR} SELECT {ACC_COLS} FROM acc WHERE state = 'O' AND acc.balance >= 200000 AND year(opened) = 1998",
    "search_transactions": f"{STAR} SELECT {TX_COLS} FROM tx WHERE type IN ('A', 'R') AND ts >= DATE '1998-01-01' AND ts < DATE '1998-04-01' AND tx.amount >= 60000",
    "search_page": f"""{STAR}, s AS (SELECT client_id, name, segment, branch_id, credit, count(*) AS accounts, sum(balance) AS balance
 FROM cli JOIN acc USING (client_id) WHERE segment = 'BUILDING' GROUP BY ALL HAVING sum(balance) >= 100000)
 SELECT client_id, name, segment, CAST(branch_id AS BIGINT) AS branch_id, CAST(credit AS DOUBLE) AS credit, accounts, CAST(s.balance AS DOUBLE) AS balance,
 CAST(2 AS BIGINT) AS page, CAST(ceil((SELECT count(*) FROM s) / 15) AS BIGINT) AS total_pages, (SELECT count(*) FROM s) AS total_rows
 FROM s ORDER BY s.balance DESC, client_id LIMIT 15 OFFSET 15""",
    "count_where": "SELECT count(*) AS rows FROM lineitem WHERE l_returnflag = 'R'",
    "client_accounts": f"""{STAR} SELECT client_id, name, segment, count(account_id) AS accounts, CAST(sum(balance) AS DOUBLE) AS balance,
 max(opened) AS last_opened FROM cli JOIN acc USING (client_id) GROUP BY ALL""",
    "mask": f"""{STAR} SELECT client_id, '****' || right(name, 4) AS name, 'XXXX' AS segment, CAST(branch_id AS BIGINT) AS branch_id,
 CAST(credit AS DOUBLE) AS credit, left(name, 1) || 'XXX@XXXX.com' AS email FROM cli""",
    "rows_for": f"{STAR} SELECT client_id, name, segment, CAST(branch_id AS BIGINT) AS branch_id, CAST(credit AS DOUBLE) AS credit FROM cli WHERE branch_id IN (3, 7)",
    "list_items": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part",
    "date_dim": """SELECT strftime(d, '%Y-%m-%d') AS date, opened, year(d) AS year, month(d) AS month, day(d) AS day, dayofweek(d) + 1 AS weekday,
 dayname(d) AS day_name, monthname(d) AS month_name, quarter(d) AS quarter,
 CAST(floor((dayofyear(d) + dayofweek(date_trunc('year', d)) - 1) / 7) + 1 AS BIGINT) AS week, dayofweek(d) IN (0, 6) AS weekend,
 strftime(d, '%m-%d') IN ('01-01', '05-01', '12-25') AS holiday, CASE strftime(d, '%m-%d') WHEN '01-01' THEN 'New Year'
 WHEN '05-01' THEN 'Labour Day' WHEN '12-25' THEN 'Christmas' END AS holiday_name
 FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS opened FROM orders GROUP BY 1)""",
    "days_without_orders": """SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY)) AS DATE) AS d)
 WHERE d NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)""",
}
