"""Predicates, scalar helpers, sources, quality, search and masks."""

import re
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.functions import exprs as x
from ledgerkit.functions import predicates as p
from checks.common import in_order
from ledgerkit.operators import aggs, govern, history, joins, ordered, paging, quality, reshape, sample, search
from ledgerkit.plans import fraud, logs, process, reports
from ledgerkit.sources import bank as views
from ledgerkit.sources import generate, readers


@pytest.fixture(scope="module")
def bank(spark, sf):
    return views.bank(spark, sf)


def pushed(df):
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return " ".join(re.findall(r"PushedFilters: \[(.*?)\]\n", text))


# Each predicate beside the form that hides the column in a function.
REWRITES = {
    "year": (lambda: p.in_year("ts", 1998), "year(ts) = 1998"),
    "month": (lambda: p.in_month("ts", 1998, 12), "year(ts) = 1998 AND month(ts) = 12"),
    "day": (lambda: p.on_day("ts", "1998-03-02"), "to_date(ts) = DATE'1998-03-02'"),
    "days": (lambda: p.between_days("ts", "1998-03-02", "1998-03-04"), "to_date(ts) BETWEEN DATE'1998-03-02' AND DATE'1998-03-04'"),
    "dateadd": (lambda: p.added_days_at_least("ts", 30, "1999-01-01"), "ts + INTERVAL 30 DAY >= TIMESTAMP_NTZ'1999-01-01'"),
    "datediff": (lambda: p.days_since_at_most("ts", 100, "2001-12-01 15:00:00"), "datediff(TIMESTAMP_NTZ'2001-12-01 15:00:00', ts) <= 100"),
    "plus": (lambda: p.plus_greater("account_id", 10, 100), "account_id + 10 > 100"),
    "prefix": (lambda: p.prefix_is("type", "A"), "left(type, 1) = 'A'"),
    "null": (lambda: p.null_or_eq("line", 3), "coalesce(line, 3) = 3"),
    "concat": (lambda: p.joined_is("type", "state", " ", "R F"), "concat(type, ' ', state) = 'R F'"),
}


@pytest.mark.parametrize("name", list(REWRITES))
def test_rewrites_give_the_same_rows(bank, name):
    build, plain = REWRITES[name]
    fast, slow = bank.tx.filter(build()), bank.tx.filter(plain)
    assert fast.exceptAll(slow).count() == 0 and slow.count() == fast.count() > 0


def test_ranges_reach_the_scan(bank, spark, sf):
    for cond in (p.in_year("ts", 1998), p.on_day("ts", "1998-03-02"), p.last("ts", 3, "month", "2001-12-01")):
        assert "GreaterThanOrEqual(l_shipdate" in pushed(bank.tx.filter(cond))
    orders = readers.load(spark, sf, "orders")
    assert "EqualTo(o_orderkey,17)" in pushed(orders.filter(p.eq_typed(orders, "o_orderkey", "17")))
    assert "StringStartsWith(o_orderpriority,1-)" in pushed(p.like_filter(orders, "o_orderpriority", "1-%"))


def test_months_and_units():
    assert p.add_months("2024-03-31", -1) == datetime(2024, 2, 29)
    assert p.add_months("2024-12-15", 2) == datetime(2025, 2, 15)
    assert p.shift("2024-01-31", 1, "quarter") == datetime(2024, 4, 30)
    assert p.shift("2024-01-31 10:00:00", -90, "minute") == datetime(2024, 1, 31, 8, 30)


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_scalar_rules(spark):
    t = lambda s: F.to_timestamp_ntz(F.lit(s))
    assert one(spark, x.date_diff("minute", t("2024-01-01 10:00:59"), t("2024-01-01 10:01:00")),
               x.date_diff("year", t("2023-12-31 00:00:00"), t("2024-01-01 00:00:00")),
               x.date_diff("week", t("2024-01-06 00:00:00"), t("2024-01-07 00:00:00")),
               x.date_diff("day", t("2024-01-06 23:59:00"), t("2024-01-07 00:00:00"))) == (1, 1, 1, 1)
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, x.week_number(d("2023-01-01")), x.week_number(d("2023-01-08")), x.week_number(d("2024-12-31"))) == (1, 2, 53)
    assert one(spark, x.text_len(F.lit("ab  ")), x.zero_pad(F.lit(7), 3), x.stuff(F.lit("abcdef"), 2, 3, "X"), x.clock_seconds(F.lit(12345))) == (2, "007", "aXef", 5025)
    assert one(spark, x.concat_skip_null(F.lit("a"), F.lit(None)), x.safe_div(F.lit(1.0), F.lit(0.0)), x.items(F.lit("A, R,,B"))) == ("a", None, ["A", "R", "B"])
    assert one(spark, x.money(F.lit(Decimal("-1234.50"))), x.day_name(d("2024-01-07")), x.month_name(d("2024-01-07"))) == ("-$1,234.50", "Sunday", "January")
    assert one(spark, x.tier(F.lit(100), [(100, "a"), (50, "b")], "c"), x.tier(F.lit(99), [(100, "a"), (50, "b")], "c"), x.tier(F.lit(1), [(100, "a")], "c")) == ("a", "b", "c")


def test_culture_parsing(spark):
    got = one(spark, x.parse_date(F.lit("15/01/2024"), "es-ES"), x.parse_date(F.lit("01/15/2024"), "en-US"),
              x.parse_date(F.lit("15 de enero de 2024"), "es-ES"), x.parse_date(F.lit("15.01.2024"), "de-DE"), x.parse_date(F.lit("error"), "es-ES"),
              x.parse_number(F.lit("1.234,56"), "es-ES"), x.parse_number(F.lit("1,234.56"), "en-US"), x.parse_number(F.lit("error"), "de-DE"))
    day = date(2024, 1, 15)
    assert got == (day, day, day, day, None, Decimal("1234.56"), Decimal("1234.56"), None)


def test_dirty_import(spark):
    rows = [
        ("2024-01-15", "1500.50", "10", "ana@email.com"), ("15/01/2024", "2500.00", "20", "carlos@test.com"), ("bad", "mil", "abc", "bad"),
        ("2024-06-30", "-500.00", "5", "m@banco.com"), (None, None, None, None), ("2024-13-45", "1000", "0", "sin_arroba.com"),
        ("2024-03-20", "750.25", "15", "no_arroba"), ("", "", "", ""), ("2024-12-31", "9999.99", "10x", "t@t.com"), ("2024-01-01", "500abc", "1", "p@m.com"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, d string, a string, q string, e string")
    fields = [quality.Field("d", "date", "ERROR_DATE", True), quality.Field("a", "decimal(10,2)", "ERROR_AMOUNT", True),
              quality.Field("q", "int", "ERROR_QUANTITY"), quality.Field("e", "email", "ERROR_EMAIL")]
    got = [r["status"] for r in quality.clean_import(df, fields).orderBy("id").collect()]
    assert got == ["OK", "ERROR_DATE", "ERROR_DATE", "OK", "NULL_DATA", "ERROR_DATE", "ERROR_EMAIL", "OK", "ERROR_QUANTITY", "ERROR_AMOUNT"]


def staging(spark):
    return spark.createDataFrame([(1, 1, 100, "2024-01-01"), (2, 1, -5, "2024-01-01"), (3, 999, 10, "2024-01-01"), (4, 1, 10, "2099-01-01"), (5, 2, 7, "2024-01-02"), (6, None, 7, "2024-01-02")],
                                 "id int, account_id int, amount int, day string")


def split(spark):
    known = spark.createDataFrame([(1,), (2,), (2,)], "account_id int")
    return lambda df: quality.validate_split(df, [("AMOUNT", F.col("amount") > 0), ("FUTURE", F.col("day") <= "2024-06-01")], [("ACCOUNT", known, "account_id", "account_id")])


def test_validation_and_migration(spark, tmp_path):
    ok, bad = split(spark)(staging(spark))
    assert sorted(r["id"] for r in ok.collect()) == [1, 5]
    assert {r["id"]: r["reason"] for r in bad.collect()} == {2: "AMOUNT", 3: "ACCOUNT", 4: "FUTURE", 6: "ACCOUNT"}
    with pytest.raises(quality.TooManyErrors):
        quality.migrate(staging(spark), split(spark), str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()
    report = quality.migrate(staging(spark), split(spark), str(tmp_path / "yes"), 0.9)
    assert {r["stage"]: r["rows"] for r in report.collect()} == {"read": 6, "rejected": 4, "written": 2}
    with pytest.raises(ValueError):
        quality.assert_none(staging(spark), F.col("account_id").isNull())
    quality.assert_none(staging(spark), F.col("id") > 6)
    written = quality.stage_and_load(spark.createDataFrame([(" a ", 1), ("b", None)], "n string, v int"), ["n"], ["v"], str(tmp_path / "load"))
    assert [tuple(r) for r in written.collect()] == [("a", 1)]


def test_files(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text("id,amount\n1,2.50\n2,x\n3,7\n")
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("amount", T.DecimalType(10, 2))])
    good, bad = readers.load_csv(spark, path, schema)
    assert sorted(r["id"] for r in good.collect()) == [1, 3]
    assert [r[readers.CORRUPT] for r in bad.collect()] == ["2,x"]
    table = str(tmp_path / "t")
    keys = readers.append_rows(good, table, ["id"])
    assert keys.count() == 2 and spark.read.parquet(table).count() == 2
    readers.truncate(spark, table, schema)
    assert spark.read.schema(schema).parquet(table).count() == 0
    for i in (1, 2):
        (tmp_path / f"log_{i}.json").write_text('{"n": %d}\n' % i)
    rolled = readers.load_log_files(spark, str(tmp_path / "log_*.json"), "json", "n int")
    assert sorted(r["n"] for r in rolled.collect()) == [1, 2] and rolled.select("file").distinct().count() == 2
    assert readers.structure_only(good).count() == 0 and readers.structure_only(good).columns == ["id", "amount"]
    readers.materialize(good, "small_rows")
    assert spark.table("small_rows").count() == 2
    readers.materialize(good, "small_global", "global")
    assert spark.table("global_temp.small_global").count() == 2
    assert readers.inline(spark, "a int", [(1,), (2,)]).count() == 2


def test_layout_prunes(spark, bank, tmp_path):
    path = str(tmp_path / "layout")
    readers.write_layout(bank.tx, path, ["state"], ["ts"])
    back = spark.read.parquet(path)
    assert back.count() == bank.tx.count()
    plan = back.filter((F.col("state") == "F") & p.in_month("ts", 1998, 3))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*state", plan)


@pytest.mark.parametrize("text", ["'; DROP TABLE CLIENTES; --", "x' OR '1'='1", "%", "_"])
def test_hostile_text_is_text(spark, bank, text):
    odd = bank.clients.limit(3).withColumn("name", F.lit(text))
    both = bank.clients.unionByName(odd)
    assert search.search_field(both, {"name": "name"}, "name", text).count() == 3
    assert search.search({"c": both}, "c", "name", text).count() == 3
    both.createOrReplaceTempView("hostile_clients")
    assert search.run_sql(spark, "SELECT * FROM hostile_clients WHERE name = :n", n=text).count() == 3
    found = search.run_sql(spark, "SELECT count(*) FROM IDENTIFIER(:t) WHERE name = :n", t="hostile_clients", n=text)
    assert search.out_value(found) == 3


def test_names_are_checked(bank):
    tables = {"clients": bank.clients}
    for call in (lambda: search.search(tables, "clients; DROP TABLE clients"), lambda: search.search(tables, "clients", "nope", 1),
                 lambda: search.search_field(bank.clients, {"name": "name"}, "credit", "1"), lambda: search.count_where(tables, "other")):
        with pytest.raises(search.UnknownName):
            call()
    assert search.search(tables, "clients", order="nope", top=5).count() == 5
    first = search.list_ordered(bank.clients, {"id": "client_id", "id_desc": "-client_id"}, "name; --", "-client_id").first()
    assert first["client_id"] == bank.clients.agg(F.max("client_id")).first()[0]
    assert "Scan parquet" in search.search_page(bank, debug=True)
    assert search.client_accounts(bank, False, False).columns == ["client_id", "name", "segment"]


def test_pages_join_to_the_whole(bank, monkeypatch):
    rows = bank.accounts.limit(95)
    for bound in (10_000, 0):
        monkeypatch.setattr(paging, "HEAD_ROWS", bound)
        pages = [paging.page(rows, ["-balance", "account_id"], n, 20).collect() for n in range(1, 6)]
        ids = [r["account_id"] for page in pages for r in sorted(page, key=lambda r: (-r["balance"], r["account_id"]))]
        assert ids == [r["account_id"] for r in rows.orderBy(F.desc("balance"), "account_id").collect()]
        assert (pages[0][0]["total_pages"], pages[0][0]["total_rows"]) == (5, 95)


def test_joins(spark, bank, rows):
    big = bank.tx.filter("amount > 50000")
    assert rows(joins.having_any(bank.accounts, big, "account_id")) == rows(joins.having_any_by_join(bank.accounts, big, "account_id"))
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    listed = lambda *v: spark.createDataFrame([(i,) for i in v], "k int")
    assert rows(joins.not_in(left, "a", listed(1), "k")) == [(2,)]
    assert rows(joins.not_in(left, "a", listed(1, None), "k")) == []
    assert joins.not_in(left, "a", listed(), "k").count() == 3
    a, b = bank.accounts.select("account_id", "client_id"), bank.clients.select("client_id", "segment")
    want = rows(a.join(b, "client_id"))
    for strategy in ("loop", "hash", "merge"):
        assert rows(joins.hinted_join(a, b, "client_id", strategy)) == want
    pairs = joins.duplicate_pairs(spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "id int, k string"), ["k"], "id")
    assert sorted((r["first_id"], r["duplicate_id"]) for r in pairs.collect()) == [(1, 2), (1, 3)]
    lists = spark.createDataFrame([("a",), ("a,b",), ("a,b,c",), ("ab",), ("a,b",)], "k string")
    got = sorted((r["shorter"], r["longer"]) for r in joins.prefix_pairs(lists, "k").collect())
    assert got == [("a", "a,b"), ("a", "a,b,c"), ("a,b", "a,b,c")]


def test_hierarchy(spark):
    edges = [(i, i - 1 if i else None) for i in range(40)] + [(100, None), (101, 100), (200, 999), (300, 301), (301, 300)]
    got = {r["id"]: (r["root"], r["level"]) for r in joins.hierarchy(spark.createDataFrame(edges, "id int, parent int"), "id", "parent").collect()}
    want = {i: (0, i + 1) for i in range(40)} | {100: (100, 1), 101: (100, 2)}
    assert got == want


def test_or_as_union_keeps_nulls(spark):
    df = spark.createDataFrame([("A", 1), (None, 2), ("B", 2), (None, 3)], "a string, b int")
    plain = df.filter("a = 'A' OR b = 2").count()
    union = df.filter("a = 'A'").unionByName(df.filter("b = 2 AND NOT (a <=> 'A')")).count()
    assert plain == union == 3


def test_reshape_and_lists(spark):
    df = spark.createDataFrame([(1, "x", 2), (1, "y", 3), (1, "x", 5), (2, None, 1)], "id int, k string, v int")
    assert {r["id"]: (r["x"], r["y"]) for r in reshape.pivot(df, ["id"], "k", "v").collect()} == {1: (7, 3), 2: (None, None)}
    assert reshape.to_attributes(df, ["id"], ["k", "v"]).count() == 7
    got = {r["id"]: r["items"] for r in aggs.string_agg(df, ["id"], "k", "|").collect()}
    assert got[1] == "x|x|y"
    long = spark.createDataFrame([(1, w) for w in "dabbbbbbca"] + [(2, "z"), (2, None)], "id int, k string")
    assert {r["id"]: r["items"] for r in aggs.string_agg(long, ["id"], "k", "").collect()} == {1: "aabbbbbbcd", 2: "z"}
    rows = aggs.ordered_items(long, ["id"], "k").filter("id = 1").orderBy("position").collect()
    assert "".join(r["k"] for r in rows) == "aabbbbbbcd" and rows[-1]["position"] == 10


def test_masks_and_rows(spark):
    df = spark.createDataFrame([("12345678", "ana@email.com", 1), ("12", None, 2)], "doc string, mail string, branch int")
    got = [tuple(r) for r in govern.mask(df, {"doc": "partial(1,***,2)", "mail": "email"}).collect()]
    assert got == [("1***78", "aXXX@XXXX.com", 1), ("***", None, 2)]
    assert govern.rows_for(df, "branch", 1).count() == 1 and govern.rows_for(df, "branch", 1, is_admin=True).count() == 2


def test_generated(spark):
    dim = generate.date_dim(spark, date(2020, 1, 1), date(2030, 12, 31), {"12-25": "Christmas"})
    assert dim.count() == 4018 and dim.filter("holiday").count() == 11
    assert generate.month_days(spark, date(2024, 2, 10)).count() == 29
    assert generate.numbers(spark, 10).agg(F.sum("n")).first()[0] == 55
    made = generate.gen_bank(spark, 0.01)
    assert (made.clients.count(), made.accounts.count(), made.tx.count()) == (100, 250, 5000)
    assert made.tx.exceptAll(generate.gen_bank(spark, 0.01).tx).count() == 0
    assert quality.orphans(made.tx, made.accounts, "account_id", "account_id").count() == 0
    volume = generate.gen_volume(spark, 500)
    assert volume.count() == 500 and volume.filter("day <= '2022-12-31' OR day > '2024-12-31'").count() == 0


def test_reports_keep_idle_clients(spark):
    clients = spark.createDataFrame([(1, "A", "R", 1, Decimal(0)), (2, "B", "R", 1, Decimal(0)), (3, "C", "S", 2, Decimal(0))], "client_id int, name string, segment string, branch_id int, credit decimal(18,2)")
    accounts = spark.createDataFrame([(10, 1, "O", "X", Decimal(100)), (11, 1, "O", "X", Decimal(50)), (12, 2, "O", "Y", Decimal(70))],
                                     "account_id int, client_id int, state string, type string, balance decimal(18,2)").withColumn("opened", F.to_timestamp_ntz(F.lit("2020-01-01 00:00:00")))
    tx = spark.createDataFrame([(10, 1, 1, 1, "A", "F", Decimal(5), "2024-01-31 23:59:00"), (10, 2, 1, 1, "N", "F", Decimal(2), "2024-01-31 23:59:00"), (11, 1, 1, 1, "A", "F", Decimal(1), "2024-02-01 00:00:00")],
                               "account_id int, line int, part_id int, supplier_id int, type string, state string, amount decimal(18,2), ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    bank = views.Bank(clients, accounts, tx)
    got = {r["client_id"]: (r["accounts"], r["balance"], r["tx_count"], r["activity"]) for r in reports.client_report(bank, "2024-02-10").collect()}
    assert got == {1: (2, 150, 3, "active"), 2: (1, 70, 0, "inactive"), 3: (0, 0, 0, "inactive")}
    listed, by_segment, total = reports.inactive_clients(bank, 30, "2024-02-10")
    assert sorted(r["client_id"] for r in listed.collect()) == [2, 3] and total.first()["dormant"] == 70
    assert {r["client_id"]: r["tx_count"] for r in reports.annual_report(bank, 2024).collect()} == {1: 3, 2: 0, 3: 0}
    january = {r["account_id"]: (r["deposits"], r["withdrawals"]) for r in reports.monthly_by_account(bank, 2024, 1).collect()}
    assert january == {10: (5, 2), 11: (0, 0), 12: (0, 0)}
    assert reports.balance(bank, 12).first()["balance"] == 70
    lines = reports.statement(bank, [1], "2024-01-01", "2024-02-01").orderBy("account_id", "line").collect()
    assert [(r["account_id"], r["running"]) for r in lines] == [(10, 5), (10, 3), (11, None)]


def test_client_reports_count_failures(spark):
    df = spark.createDataFrame([(1, 5), (2, 0), (3, 2)], "client_id int, v int")
    text = F.floor(F.try_divide(F.lit(10), F.col("v"))).cast("string")
    out = reports.client_reports(df, text, [(F.col("v") == 0, "division by zero")])
    assert {r["client_id"]: r["report"] for r in out.collect()} == {1: "2", 2: None, 3: "5"}
    assert tuple(reports.report_counts(out).first()) == (2, 1)


def test_alert_rules(spark):
    rows = [(i, 1, f"2024-01-{1 + i:02d} 12:00:00", "Lima", Decimal(100 + i)) for i in range(12)]
    rows += [(20, 1, "2024-02-01 10:00:00", "Lima", Decimal(110)), (21, 1, "2024-02-01 10:00:02", "Quito", Decimal(110)),
             (22, 1, "2024-02-01 10:00:04", "Bogota", Decimal(50000)), (23, 2, "2024-02-01 05:59:59", "Lima", Decimal(10)), (24, 2, "2024-02-01 06:00:00", "Lima", Decimal(10))]
    log = spark.createDataFrame(rows, "event_id int, account_id int, ts string, place string, amount decimal(18,2)").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = [(r["alert"], r["account_id"], r["severity"]) for r in fraud.alerts(log, "2024-02-01 10:01:00", n=3, k=3.0).collect()]
    assert got == [("IMPOSSIBLE_TRAVEL", 1, "CRITICAL")] * 2 + [("HIGH_FREQUENCY", 1, "HIGH"), ("UNUSUAL_AMOUNT", 1, "MEDIUM"), ("OFF_HOURS", 2, "LOW")]
    with pytest.raises(TypeError):
        fraud.purge_table(log, "place", 30, "2024-02-01")
    kept, note = fraud.purge_audit(log, 20, "2024-02-01", dry_run=True)
    assert kept.count() == log.count() and note.first()["rows"] == 11
    queue, per_analyst, frauds = reports.alert_queue(spark.createDataFrame(
        [(1, "FRAUD", 4, "2024-01-20 00:00:00", "OPEN", "ana"), (2, "LIMIT", 2, "2024-01-21 00:00:00", "OPEN", "ana"), (3, "FRAUD", 5, "2023-01-20 00:00:00", "CLOSED", None)],
        "alert_id int, type string, severity int, ts string, state string, analyst string").withColumn("ts", F.to_timestamp_ntz("ts")), "2024-02-01")
    assert [r["alert_id"] for r in queue.collect()] == [1] and frauds.count() == 1 and per_analyst.count() == 3


def test_bad_documents_give_nulls(spark):
    docs = spark.createDataFrame([(1, '<event name="e" timestamp="2024-01-01T10:00:00"><data name="duration"><value>12</value></data></event>'),
                                  (2, '<event name="e" timestamp="bad"><data name="duration"><value>x</value></data><action name="login"><value>u</value></action></event>'),
                                  (3, "not xml")], "id int, xml string")
    out = {r["id"]: tuple(r)[1:] for r in logs.parse_events(docs, {"duration": ("data", "int"), "login": ("action", "string")}).collect()}
    assert out[1] == ("e", datetime(2024, 1, 1, 10), 12, None) and out[2] == ("e", None, None, "u") and out[3] == (None,) * 4


def test_recent_events_parse_a_document_once(spark, capsys):
    docs = spark.createDataFrame(
        [(i, f'<event name="{"error" if i % 3 else "view"}" timestamp="2024-01-{i + 20}T10:00:00"/>') for i in range(1, 8)], "id int, xml string")
    parsed = logs.parse_events(docs.repartition(2), {"duration": ("data", "int")})
    parsed.filter((F.col("name") == "error") & (F.col("ts") > "2024-01-22")).explain()
    assert capsys.readouterr().out.count("from_xml(") == 1
    recent = logs.recent(parsed, "error", 96, "2024-01-26 00:00:00")
    assert [r["id"] for r in recent.collect()] == [5, 4, 2]
    recent.explain()
    assert "from_xml(" not in capsys.readouterr().out  # sorting samples rows that are parsed already


def test_top_per_group_beyond_the_limit(bank, monkeypatch, rows):
    want = rows(ordered.top_per_group(bank.tx, ["type"], ["-ts", "account_id", "line", "part_id", "supplier_id"], 30))
    monkeypatch.setattr(ordered, "GROUP_LIMIT", 10)
    assert rows(ordered.top_per_group(bank.tx, ["type"], ["-ts", "account_id", "line", "part_id", "supplier_id"], 30)) == want


def test_log_outlives_a_failure(spark):
    def fails():
        raise ValueError("no funds")

    results, log = process.run_logged(spark, [("read", lambda: 5), ("post", fails), ("report", lambda: 6)])
    assert results == [5]
    assert [tuple(r)[2:] for r in log.orderBy("step").collect()] == [("DONE", None), ("ERROR", "no funds"), ("SKIPPED", None)]


def scanned(df):
    """Rows that the scan of a plain read gave, and the rows of the result."""
    n = len(df.collect())
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value(), n


def test_lookups_read_what_can_hold_the_key(spark, tmp_path):
    df = spark.range(200_000).select("id", ((F.col("id") * 7919) % 100_003).alias("other"), F.lit("x" * 20).alias("t"))
    readers.write_lookup(df, str(tmp_path / "l"), ["id"], ["other"], group_bytes=1 << 16, page_rows=500)
    back = spark.read.parquet(str(tmp_path / "l"))
    assert back.count() == 200_000
    read, found = scanned(back.filter("id = 12345"))
    assert found == 1 and read <= 1_000  # pages of one row group
    value = df.filter("id = 777").first()["other"]
    read, found = scanned(back.filter(F.col("other") == value))
    assert found == df.filter(F.col("other") == value).count() and read < 60_000
    read, found = scanned(back.filter("other = 100_005 - 1".replace("_", "")))
    assert found == 0 and read < 60_000


def test_lookup_bank_gives_the_same_rows(spark, sf, rows, tmp_path):
    plain, laid = views.bank(spark, sf), views.lookup_bank(spark, sf, str(tmp_path / "bank"))
    assert rows(laid.accounts) == rows(plain.accounts) and rows(laid.clients) == rows(plain.clients)
    assert rows(laid.tx.drop("client_id")) == rows(plain.tx)
    files = {f: f.stat().st_mtime for f in (tmp_path / "bank").rglob("*.parquet")}
    again = views.lookup_bank(spark, sf, str(tmp_path / "bank"))
    assert {f: f.stat().st_mtime for f in (tmp_path / "bank").rglob("*.parquet")} == files
    client = plain.accounts.first()["client_id"]
    period = ("1990-01-01", "2000-01-01")
    assert rows(reports.statement(again, [client], *period)) == rows(reports.statement(plain, [client], *period))


def test_the_order_oracle_notices_a_turned_order(spark):
    df = spark.range(50).select("id", (F.col("id") % 7).alias("k"))
    want = {r["id"]: sum(1 for j in range(50) if j % 7 < r["k"]) + 1 for r in df.collect()}
    got = {r["id"]: r["position"] for r in in_order(df.orderBy("k"), "k").collect()}
    assert got == want
    assert {r["id"]: r["position"] for r in in_order(df.orderBy(F.desc("k")), "k").collect()} != want


@pytest.mark.parametrize("rows_per_slice", [2_000_000, 20])
def test_stratified_samples(spark, monkeypatch, rows_per_slice):
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", rows_per_slice)
    df = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 2).alias("s")).repartition(5)
    found = {share: {r["id"]: r["s"] for r in sample.stratified(df, ["s"], ["id"], share, 3).collect()} for share in (0, 0.1, 0.25, 1)}
    sizes = {r["s"]: r["count"] for r in df.groupBy("s").count().collect()}
    for share, rows_of in found.items():
        for s, n in sizes.items():
            assert sum(v == s for v in rows_of.values()) == -(-n * round(100 * share) // 100)
    assert found[0.1].items() <= found[0.25].items() <= found[1].items() and len(found[1]) == 500
    again = sample.stratified(df.orderBy(F.rand()), ["s"], ["id"], 0.25, 3)
    assert {r["id"] for r in again.collect()} == set(found[0.25]) != {r["id"] for r in sample.stratified(df, ["s"], ["id"], 0.25, 4).collect()}
    assert sample.stratified(df, [], ["id"], 0.5).count() == 250


def test_images_of_changing_structure_are_decoded(spark, rows):
    audit = spark.createDataFrame([
        (1, None, '{"a":1,"n":{"x":[1,2]}}'), (2, '{"a":1,"b":null}', '{"a":"1","b":2.50}'), (3, '{"a":null}', None),
        (4, '{"a":1,"n":{"x":1}}', '{"n":{"x":2},"c":true}'), (5, "no json", '{"a":3}'), (6, None, None)], "id int, before string, after string")
    assert rows(history.field_changes(audit, ["id"])) == sorted([
        (1, "a", None, "1"), (1, "n", None, '{"x":[1,2]}'), (2, "b", None, "2.5"), (4, "a", "1", None),
        (4, "n", '{"x":1}', '{"x":2}'), (4, "c", None, "true"), (5, "a", None, "3")], key=repr)
