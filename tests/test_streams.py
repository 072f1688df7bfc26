"""Streams give what the batch form gives, in any number of batches, also after a restart."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerkit.operators import history
from ledgerkit.plans import fraud
from ledgerkit.streaming import buckets, monitors

SCHEMA = "event_id long, account_id int, ts timestamp_ntz, place string, amount double, duration int"


@pytest.fixture(scope="module")
def events(spark):
    start, out = datetime(2024, 1, 1), []
    for i in range(120):
        out.append((i, 1 if i % 3 else i % 7, start + timedelta(minutes=9 * i), "ABC"[i * i % 3], float(i), i % 10))
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="module")
def folder(events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("feed"))
    for lo in (0, 40, 80):
        events.filter(F.col("event_id").between(lo, lo + 39)).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder, events):
    return monitors.read_files(spark, folder, events.schema, per_batch=1)


def test_travel_matches_batch_and_restart_adds_nothing(spark, events, folder, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(monitors, "FULL_EVERY", 2)
    want = fraud.impossible_travel(events).select("event_id", "previous_place")
    for _ in range(2):
        monitors.travel_stream(stream(spark, folder, events), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
        got = spark.read.parquet(str(tmp_path / "t/alerts")).select("event_id", "previous_place")
        assert rows(got) == rows(want)


def test_travel_with_a_late_file_matches_batch(spark, events, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(monitors, "FULL_EVERY", 2)
    late = "event_id % 10 = 5 and event_id < 110"
    feed = str(tmp_path / "feed")
    for part in (f"event_id < 60 and not ({late})", f"event_id >= 60 and not ({late})", late):
        events.filter(part).coalesce(1).write.mode("append").parquet(feed)
        time.sleep(1.1)  # the files are read in the order of their times
    monitors.travel_stream(stream(spark, feed, events), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    columns = ["event_id", "previous_place"]
    got = monitors.travel_alerts(spark, str(tmp_path / "t")).select(*columns)
    assert rows(got) == rows(fraud.impossible_travel(events).select(*columns))
    assert spark.read.parquet(str(tmp_path / "t/late")).count() == 0
    assert spark.read.parquet(str(tmp_path / "t/parted")).count() > 0
    short = monitors.travel_stream(stream(spark, feed, events), str(tmp_path / "s"), str(tmp_path / "cs"), lateness=timedelta(hours=2))
    short.awaitTermination()
    mark = events.filter(f"not ({late})").agg(F.max("ts")).first()[0] - timedelta(hours=2)
    want = events.filter(late).filter(F.col("ts") < F.lit(mark))
    assert rows(spark.read.parquet(str(tmp_path / "s/late")).select("event_id")) == rows(want.select("event_id"))
    assert rows(monitors.travel_alerts(spark, str(tmp_path / "s")).select(*columns)) == rows(
        fraud.impossible_travel(events.join(want, "event_id", "left_anti")).select(*columns))


def test_travel_opens_the_state_of_its_own_keys_only(spark, events, folder, rows, tmp_path, monkeypatch):
    feed, opened = str(tmp_path / "feed"), []
    one = events.filter("account_id <> 1").limit(1).first()["account_id"]
    last = (F.col("account_id") == one) & (F.col("event_id") > 60)
    plain = buckets.read_parts
    monkeypatch.setattr(buckets, "read_parts", lambda s, p, parts, *more: opened.append({q["bucket"] for q in parts}) or plain(s, p, parts, *more))
    for part in (~last & (F.col("event_id") < 60), ~last & (F.col("event_id") >= 60), last):
        events.filter(part).coalesce(1).write.mode("append").parquet(feed)
        time.sleep(1.1)
    monitors.travel_stream(stream(spark, feed, events), str(tmp_path / "t"), str(tmp_path / "cp")).awaitTermination()
    keys = events.filter(last).select(buckets.bucket_of(["account_id"], monitors.STATE_BUCKETS)).distinct().collect()
    assert opened[-1] == {r[0] for r in keys} and len(opened[-1]) == 1 < len(opened[1])
    assert rows(monitors.travel_alerts(spark, str(tmp_path / "t")).select("event_id", "previous_place")) == rows(
        fraud.impossible_travel(events).select("event_id", "previous_place"))


def test_cdc_matches_batch(spark, events, folder, rows, tmp_path):
    feed = stream(spark, folder, events).select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(4).alias("op"),
        (F.col("event_id") % 13).alias("key"), "amount")
    flat = events.select(
        F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(4).alias("op"),
        (F.col("event_id") % 13).alias("key"), "amount")
    want = history.net_changes(flat, ["key"]).filter("op <> 1").select("key", "amount")
    table, schema = str(tmp_path / "t"), want.schema
    for _ in range(2):
        monitors.cdc_stream(feed, table, str(tmp_path / "cp"), ["key"], ["key", "amount"]).awaitTermination()
        assert rows(buckets.read(spark, table, schema, ["key"])) == rows(want)
    early = history.net_changes(flat.filter("seq < 80"), ["key"]).filter("op <> 1").select("key", "amount")
    assert rows(buckets.read(spark, table, schema, ["key"], batch=1)) == rows(early)


def change(spark, rows):
    return spark.createDataFrame(rows, "seq long, op int, key long, v string")


def files_of(path):
    return {str(f.relative_to(path)) for kind in ("base", "delta") for f in (path / kind).rglob("*.parquet")}


def test_untouched_buckets_keep_their_files_and_full_ones_are_merged(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "COMPACT_AFTER", 3)
    schema, want = spark.createDataFrame([], "key long, v string").schema, {}
    for batch in range(8):
        one = [(batch * 10, 2 if batch == 0 else 4, 1, f"a{batch}"), (batch * 10 + 1, 4, 50 + batch, "x"), (batch * 10 + 2, 1, 49 + batch, None),
               (batch * 10 + 3, 3, 1, "image before")]
        if batch == 0:
            one += [(5 + i, 2, 100 + i, f"k{i}") for i in range(40)]
        before = files_of(tmp_path) if batch else set()
        buckets.apply(change(spark, one), str(tmp_path), batch, ["key"], ["key", "v"], 16)
        fresh = files_of(tmp_path) - before
        assert files_of(tmp_path) >= before and all(f"batch={batch}/" in f for f in fresh)
        if batch:
            assert len({f.split("/")[2] for f in fresh}) <= 3  # three keys
        for _, op, key, v in one:
            if op == 1:
                want.pop(key, None)
            elif op != 3:
                want[key] = v
        assert {tuple(r) for r in buckets.read(spark, str(tmp_path), schema, ["key"]).collect()} == set(want.items())
    assert any(f.startswith("base/") for f in files_of(tmp_path))
    # The last batch once more gives the same table.
    buckets.apply(change(spark, one), str(tmp_path), 7, ["key"], ["key", "v"])
    assert {tuple(r) for r in buckets.read(spark, str(tmp_path), schema, ["key"]).collect()} == set(want.items())
    assert buckets.vacuum(spark, str(tmp_path)) > 0 and buckets.batches(spark, str(tmp_path)) == [7]
    assert {tuple(r) for r in buckets.read(spark, str(tmp_path), schema, ["key"]).collect()} == set(want.items())


def test_a_batch_without_its_manifest_is_not_seen(spark, tmp_path):
    schema = spark.createDataFrame([], "key long, v string").schema
    buckets.apply(change(spark, [(1, 2, 1, "a")]), str(tmp_path), 0, ["key"], ["key", "v"])
    buckets.apply(change(spark, [(2, 4, 1, "b")]), str(tmp_path), 1, ["key"], ["key", "v"])
    (tmp_path / "manifest/batch=1/_SUCCESS").rename(tmp_path / "lost")
    assert buckets.read(spark, str(tmp_path), schema, ["key"]).collect() == [(1, "a")]
    buckets.apply(change(spark, []), str(tmp_path), 2, ["key"], ["key", "v"])
    assert buckets.read(spark, str(tmp_path), schema, ["key"]).collect() == [(1, "a")]


def test_slow_monitor_and_windows(spark, events, folder, tmp_path):
    source = stream(spark, folder, events)
    monitors.slow_monitor(source, 8, str(tmp_path / "slow"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "slow")).count() == events.filter("duration >= 8").count()
    often = monitors.frequency_stream(source, "1 hour", None, "0 seconds", 5)
    monitors.to_files(often, str(tmp_path / "often"), str(tmp_path / "c2")).awaitTermination()
    last = events.agg(F.max("ts")).first()[0]
    want = events.groupBy("account_id", F.date_trunc("hour", "ts").alias("start")).count().filter("count >= 5").filter(
        F.col("start") + F.expr("INTERVAL 1 HOUR") <= F.lit(last.isoformat(" ")))
    assert spark.read.parquet(str(tmp_path / "often")).count() == want.count() > 0
