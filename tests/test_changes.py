"""Merges, batches, versions, audit and change feeds."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerkit.operators import history, merge

PRODUCT = "product_id int, name string, price decimal(10,2), active boolean"


def products(spark):
    target = spark.createDataFrame([
        (1, "Keyboard", Decimal(25), True), (2, "Mouse", Decimal(15), True), (3, "Screen", Decimal(200), True),
        (6, None, Decimal(1), True), (7, "Pad", Decimal(2), True)], PRODUCT)
    source = spark.createDataFrame([
        (1, "Keyboard", Decimal(30)), (2, "Mouse", Decimal(15)), (4, "Camera", Decimal(50)), (5, "Headset", Decimal(45)),
        (6, "Cable", Decimal(1)), (7, None, Decimal(2))], "product_id int, name string, price decimal(10,2)")
    return target, source


def test_upsert_actions(spark):
    target, source = products(spark)
    out = merge.upsert(target, source, ["product_id"], ["name", "price"], "deactivate")
    actions = {r["product_id"]: r["action"] for r in out.actions.collect()}
    assert actions == {1: "UPDATE", 3: "DEACTIVATE", 4: "INSERT", 5: "INSERT", 6: "UPDATE", 7: "UPDATE"}
    rows = {r["product_id"]: tuple(r)[1:] for r in out.target.collect()}
    assert rows[3] == ("Screen", 200, False) and rows[4] == ("Camera", 50, True) and rows[7] == (None, 2, True)


def test_upsert_twice_changes_nothing(spark, rows):
    target, source = products(spark)
    for mode in ("keep", "delete", "deactivate"):
        once = merge.upsert(target, source, ["product_id"], ["name", "price"], mode).target
        again = merge.upsert(once, source, ["product_id"], ["name", "price"], mode)
        assert again.actions.count() == 0
        assert rows(again.target) == rows(once)


def test_upsert_refuses_double_keys(spark):
    target, source = products(spark)
    with pytest.raises(ValueError):
        merge.upsert(target, source.unionByName(source), ["product_id"], ["name", "price"])


def test_delete_where_keeps_unknown(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "id int, v int")
    kept, deleted = merge.delete_where(df, F.col("v") > 6)
    assert [r["id"] for r in kept.orderBy("id").collect()] == [1, 2]
    assert [r["id"] for r in deleted.collect()] == [3]


def test_archive_is_not_doubled(spark):
    df = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-06-01"), (3, "2024-01-01")], "id int, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    fresh, stay = merge.archive_older(df, df.filter("id = 1"), ["id"], "ts", "2023-01-01")
    assert [r["id"] for r in fresh.collect()] == [2] and [r["id"] for r in stay.collect()] == [3]


def test_batches_resume_after_a_failure(spark, tmp_path):
    df = spark.range(1, 1001).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "run")
    ids = lambda: {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "run/data").glob("batch=*")}

    def fails_third(part):
        return part.withColumn("v", F.when(F.col("batch") == 3, F.raise_error(F.lit("stop")).cast("long")).otherwise(F.col("v")))

    with pytest.raises(Exception, match="stop"):
        merge.run_batches(df, "id", 125, path, fails_third, per_job=2)
    assert merge.read_state(spark, path).count() == 2
    before = ids()
    state = merge.run_batches(df, "id", 125, path, lambda part: part, per_job=3)
    assert {k: v for k, v in ids().items() if k in before} == before and len(ids()) == state.count() >= 8
    written = spark.read.parquet(path + "/data")
    assert written.count() == 1000 and written.select("id").distinct().count() == 1000
    assert state.agg(F.sum("rows")).first()[0] == 1000
    uppers = [int(r["last_key"]) for r in state.orderBy("batch").collect()]
    assert uppers == sorted(uppers) and written.groupBy("batch").agg(F.max("id").alias("m")).orderBy("batch").collect() == [
        (n, u) for n, u in enumerate(uppers, 1)]
    assert merge.run_batches(df, "id", 125, path, lambda part: part).count() == state.count()
    one = merge.run_batches(df, "id", 125, str(tmp_path / "other"), lambda part: part, max_batches=1)
    assert one.count() == 1


def test_many_batches_take_few_jobs(spark, tmp_path):
    """The number of jobs, each of which reads the table, does not grow with it."""
    df, path = spark.range(1, 101).select("id", F.col("id").cast("decimal(12,2)").alias("k")), str(tmp_path / "run")
    state = merge.run_batches(df, "k", 2, path, lambda part: part.filter("id <> 7 and id <> 8"), per_job=1)
    assert len([p for p in (tmp_path / "run/state").iterdir()]) == merge.MAX_JOBS
    rows = state.orderBy("batch").collect()
    assert [r["batch"] for r in rows] == list(range(1, len(rows) + 1)) and len(rows) >= 45 and sum(r["rows"] for r in rows) == 98
    uppers = [0.0, *[float(r["last_key"]) for r in rows]]
    for r in spark.read.parquet(path + "/data").collect():
        assert uppers[r["batch"] - 1] < r["k"] <= uppers[r["batch"]]
    nothing = merge.run_batches(df, "k", 30, str(tmp_path / "none"), lambda part: part.filter("id < 0"))
    assert nothing.agg(F.sum("rows")).first()[0] == 0


def test_a_broken_job_is_written_again(spark, tmp_path):
    """Files without a state row, as left by a run that ended between the two, are replaced."""
    df, path = spark.range(1, 101).withColumn("v", F.lit(1)), str(tmp_path / "run")
    merge.run_batches(df, "id", 25, path, lambda part: part.withColumn("v", F.lit(9)))
    for entry in (tmp_path / "run/state").iterdir():
        entry.rename(tmp_path / "lost")
    merge.run_batches(df, "id", 25, path, lambda part: part)
    assert spark.read.parquet(path + "/data").agg(F.count("v"), F.max("v")).first() == (100, 1)


def test_batch_progress(spark):
    df = spark.createDataFrame([(1, "copy", "DONE", 600, "2024-01-01 10:00:30", "2024-01-01 10:04:10"), (2, "copy", "RUN", 0, "2024-01-01 10:00:00", None)],
                               "process_id int, name string, state string, rows long, start string, updated string")
    df = df.withColumns({"start": F.to_timestamp_ntz("start"), "updated": F.to_timestamp_ntz("updated")})
    got = {r["process_id"]: (r["minutes"], r["rows_per_minute"]) for r in merge.batch_progress(df, "2024-01-01 10:00:00").collect()}
    assert got == {1: (4, 150.0), 2: (0, None)}


def test_scd2(spark):
    dim = spark.createDataFrame([
        (1, 1, "Ana", "Main 1", date(2020, 1, 1), None, True), (2, 2, "Carlos", "Central 50", date(2021, 6, 15), None, True),
        (3, 3, "Maria", "Plaza 10", date(2022, 3, 20), None, True)],
        "sk long, client_id int, name string, address string, start date, end date, current boolean")
    src = spark.createDataFrame([(1, "Ana", "New 100"), (2, "Carlos", "Central 50"), (4, "Pedro", "North 25")], "client_id int, name string, address string")
    out, actions = history.scd2_apply(dim, src, "client_id", ["name", "address"], "2024-05-10")
    assert {r["client_id"]: r["action"] for r in actions.collect()} == {1: "CHANGE", 2: "SAME", 4: "NEW"}
    got = {(r["client_id"], r["sk"]): (r["address"], r["end"], r["current"]) for r in out.collect()}
    assert got == {
        (1, 1): ("Main 1", date(2024, 5, 9), False), (1, 4): ("New 100", None, True), (2, 2): ("Central 50", None, True),
        (3, 3): ("Plaza 10", None, True), (4, 5): ("North 25", None, True)}


@pytest.fixture(scope="module")
def hist(spark):
    changes = spark.createDataFrame([
        (1, 10, "2024-01-01 00:00:00"), (1, 20, "2024-02-01 00:00:00"), (1, 30, "2024-03-01 00:00:00"), (2, 5, "2024-02-15 00:00:00")],
        "limit_id int, amount int, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    return history.versions(changes, ["limit_id"], "ts", "amount").cache()


def amounts(df):
    return sorted(r["amount"] for r in df.collect())


def test_temporal_reads(hist):
    assert amounts(history.as_of(hist, "2024-02-01")) == [20]
    assert amounts(history.as_of(hist, "2023-12-31")) == []
    assert amounts(history.as_of(hist, "2024-02-29 23:59:59")) == [5, 20]
    assert amounts(history.between(hist, "2024-02-01", "2024-03-01")) == [5, 20, 30]
    assert amounts(history.from_to(hist, "2024-02-01", "2024-03-01")) == [5, 20]
    assert amounts(history.contained_in(hist, "2024-01-01", "2024-03-01")) == [10, 20]
    report = {r["amount"]: (r["status"], r["days_in_force"]) for r in history.version_report(hist, "2024-03-11").collect()}
    assert report == {10: ("HISTORIC", 31), 20: ("HISTORIC", 29), 30: ("CURRENT", 10), 5: ("CURRENT", 25)}
    assert amounts(history.trim_history(hist, 2, "2026-02-15")) == [5, 20, 30]


def test_audit(spark):
    before = spark.createDataFrame([(1, "a@x", 5), (2, "b@x", 6), (3, None, 7)], "id int, email string, v int")
    after = spark.createDataFrame([(1, "a@y", 5), (3, None, 7), (4, "d@x", 1)], "id int, email string, v int")
    got = {r["key"]: (r["op"], r["before"], r["after"]) for r in history.audit_diff(before, after, None, "clients", {"clients": ["id"]}).collect()}
    assert got["1"] == ("U", '{"id":1,"email":"a@x","v":5}', '{"id":1,"email":"a@y","v":5}')
    assert got["2"][0] == "D" and got["4"][0] == "I" and "3" not in got
    assert history.audit_diff(before, after, ["id"], "clients", skip_unchanged=False).count() == 4


FEED = "seq long, op int, key int, v int"
CHANGES = [
    (1, 2, 1, 10), (2, 1, 1, 10), (3, 2, 2, 5), (4, 3, 2, 5), (5, 4, 2, 6), (6, 3, 3, 1), (7, 4, 3, 2), (8, 4, 3, 3),
    (9, 1, 4, 9), (10, 2, 4, 11), (11, 1, 5, 0),
]


def test_net_changes(spark, rows):
    feed = spark.createDataFrame(CHANGES, FEED)
    net = history.net_changes(feed, ["key"])
    assert {r["key"]: (r["op"], r["v"]) for r in net.collect()} == {2: (2, 6), 3: (4, 3), 4: (4, 11), 5: (1, 0)}
    old = spark.createDataFrame([(3, 1), (4, 9), (5, 0), (6, 6)], "key int, v int")
    assert rows(history.apply_changes(old, net, ["key"])) == [(2, 6), (3, 3), (4, 11), (6, 6)]
    assert history.net_changes(feed, ["key"], 100, 200).count() == 0


def test_consumer_repeats_a_broken_run(spark, tmp_path):
    feed, path, seen = spark.createDataFrame(CHANGES, FEED), str(tmp_path / "state"), []

    def work(changes, run):
        got = [r["seq"] for r in changes.orderBy("seq").collect()]
        seen.append((run, got[0], got[-1]))
        if len(seen) == 2:
            raise RuntimeError("stop")

    history.consume_changes(feed.filter("seq <= 4"), path, work)
    with pytest.raises(RuntimeError):
        history.consume_changes(feed.filter("seq <= 8"), path, work)
    history.consume_changes(feed, path, work)
    history.consume_changes(feed, path, work)
    log = history.consume_changes(feed, path, work)
    assert seen == [(1, 1, 4), (2, 5, 8), (2, 5, 8), (3, 9, 11)]
    assert log.filter("state = 'DONE'").count() == 3
