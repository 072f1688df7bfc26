"""Sliced windows must equal plain Spark windows, whatever the skew."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerkit import session
from ledgerkit.operators import joins, ledger
from ledgerkit.operators import ordered as o


@pytest.fixture(scope="module")
def data(spark):
    """Key 1 holds most rows, one timestamp of it holds half of those, keys and values have nulls."""
    rows = []
    for i in range(400):
        key = 1 if i % 3 else (None if i % 7 == 0 else i % 5 + 2)
        day = 50 if i % 2 else (i * 37) % 90
        rows.append((key, day, i, None if i % 11 == 0 else float(i % 17)))
    df = spark.createDataFrame(rows, "k int, d int, id int, v double")
    return df.repartition(4).cache()


ORDERS = [["d", "-id"], ["-d", "id"]]


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_and_number(data, rows, keys, order):
    w = Window.partitionBy(*keys).orderBy(*o.sort_columns(order))
    want = data.withColumn("s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    want = want.withColumn("rn", F.row_number().over(w).cast("long"))
    got = o.with_running(data, keys, order, {"s": F.col("v")}, rows_per_slice=20)
    got = o.number_rows(got, keys, order, "rn", rows_per_slice=20)
    assert rows(got) == rows(want)


def test_slices_are_made_and_split_ties(data):
    laid = o.layout(data, ["k"], ["d", "id"], rows_per_slice=20)
    assert laid.sliced
    biggest = laid.df.groupBy("k", "__slice").count().agg(F.max("count")).first()[0]
    assert biggest <= 60
    cut = laid.pieces.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()
    assert all(r["n"] > 1 for r in cut) and len(cut) <= laid.df.select("__slice").distinct().count()


@pytest.mark.parametrize("order", ORDERS)
def test_lag_lead_moving(data, rows, order):
    w = Window.partitionBy("k").orderBy(*o.sort_columns(order))
    want = data.select(
        "*", F.lag("v", 2).over(w).alias("a"), F.lead("v").over(w).alias("b"),
        F.avg("v").over(w.rowsBetween(-3, 0)).alias("m"),
    )
    got = o.lagged(data, ["k"], order, {"a": "v"}, 2, rows_per_slice=20)
    got = o.led(got, ["k"], order, {"b": "v"}, rows_per_slice=20)
    got = o.moving(got, ["k"], order, 3, {"m": F.avg("v")}, rows_per_slice=20)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("value", ["v", "-v"])
def test_ranks(data, rows, keys, value):
    w = Window.partitionBy(*keys).orderBy(*o.sort_columns([value]))
    want = data.select(
        "*", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("q"),
        F.percent_rank().over(w).alias("p"),
    )
    got = o.with_ranks(data, keys, value, "r", "q", "p", rows_per_slice=5)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("tiles", [7])
def test_ntile(data, rows, tiles):
    w = Window.partitionBy("k").orderBy("d", "id")
    want = data.select("*", F.ntile(tiles).over(w).cast("long").alias("t"))
    assert rows(o.with_ntile(data, ["k"], ["d", "id"], tiles, "t", rows_per_slice=20)) == rows(want)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_percentiles(data, keys):
    want = data.groupBy(*keys).agg(F.expr("percentile(v, 0.95)").alias("a"), F.expr("percentile(v, 0.5)").alias("b"))
    got = o.exact_percentiles(data, keys, "v", {"a": 0.95, "b": 0.5}, rows_per_slice=4)
    as_map = lambda df: {tuple(r)[:-2]: pytest.approx(tuple(r)[-2:]) for r in df.collect()}
    expected, found = as_map(want), got.collect()
    assert {tuple(r)[:-2] for r in found} == expected.keys()
    for r in found:
        assert tuple(r)[-2:] == expected[tuple(r)[:-2]]


def test_first_last_top_latest(data, rows):
    w = Window.partitionBy("k").orderBy("d", "id")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    want = data.select("*", F.first("v").over(full).alias("f"), F.last("v").over(full).alias("l"))
    assert rows(o.first_last(data, ["k"], ["d", "id"], "v", "f", "l")) == rows(want)
    top = data.withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 3")
    assert rows(o.top_per_group(data, ["k"], ["d", "id"], 3)) == rows(top)
    assert o.latest(data, ["k"], ["d", "id"]).count() == data.select("k").distinct().count()


def test_text_order_is_sliced(spark, rows):
    df = spark.range(300).select(
        (F.col("id") % 2).alias("k"), F.concat(F.lit("2024-01-"), F.lpad((F.col("id") * 7 % 31).cast("string"), 2, "0")).alias("t"), "id")
    assert o.layout(df, ["k"], ["t", "id"], 20).df.select("__slice").distinct().count() > 3
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("rn", F.row_number().over(w).cast("long"))
    assert rows(o.number_rows(df, ["k"], ["t", "id"], "rn", rows_per_slice=20)) == rows(want)
    down = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("t"), "id")).cast("long"))
    assert rows(o.number_rows(df, ["k"], ["-t", "id"], "rn", rows_per_slice=20)) == rows(down)


def test_copies_are_removed(spark, monkeypatch, tmp_path):
    """A loop leaves its last copy, and the end of a scratch block nothing."""
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: str(tmp_path))
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "id int, up int")
    levels = joins.hierarchy(tree, "id", "up")
    assert levels.count() == 20 and len(list(tmp_path.iterdir())) == 1
    with session.scratch(spark):
        rows = spark.createDataFrame([(i, 1, 40, 100) for i in range(9)], "id long, g long, cents long, room long")
        assert ledger.accept_in_order(rows, ["g"], ["id"], group_rows=3).filter("accepted").count() == 2
        assert len(list(tmp_path.iterdir())) > 1
    assert len(list(tmp_path.iterdir())) == 1


def test_a_repeated_text_is_cut_by_the_next_column(spark):
    rows = [(1, "Customer#0001" if i % 3 else "Customer#0002", f"Item#{i * 7919 % 4000:06d}", i) for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, name string, item string, v int")
    laid = o.layout(df, ["k"], ["name", "item"], rows_per_slice=100)
    sizes = [r["count"] for r in laid.df.groupBy("__slice").count().collect()]
    assert max(sizes) <= 300 and sum(sizes) == 4000
    got = o.number_rows(df, ["k"], ["name", "item"], "rn", 100)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("name", "item")))
    assert sorted(map(tuple, got.select("v", "rn").collect())) == sorted(map(tuple, plain.select("v", "rn").collect()))


def test_ties_in_two_columns_are_cut_by_the_third_and_equal_rows_by_their_place(spark, rows):
    data = [(1, 7, 7, i % 50, float(i % 13)) for i in range(1500)] + [(1, 7, 7, 3, 2.0)] * 900 + [(2, 1, 1, 1, 1.0)]
    df = spark.createDataFrame(data, "k int, a int, b int, c int, v double").repartition(4)
    laid = o.layout(df, ["k"], ["a", "-b", "c"], 100)
    assert laid.df.groupBy("__slice").count().agg(F.max("count")).first()[0] <= 400
    w = Window.partitionBy("k").orderBy("a", F.desc("b"), "c")
    numbered = o.number_rows(df, ["k"], ["a", "-b", "c"], "rn", 100)
    assert sorted(r[0] for r in numbered.filter("k = 1").select("rn").collect()) == list(range(1, 2401))
    want = df.withColumn("rn", F.row_number().over(w)).groupBy("k", "a", "b", "c").agg(F.min("rn").cast("long").alias("m"), F.max("rn").cast("long").alias("x"))
    assert rows(numbered.groupBy("k", "a", "b", "c").agg(F.min("rn").alias("m"), F.max("rn").alias("x"))) == rows(want)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_looking_back_over_many_slices(spark, rows, keys):
    """n = 10,000 over slices of 1,500 rows: a halo spans several slices."""
    df = spark.range(30_000).select((F.col("id") % 97 == 0).cast("int").alias("k"), ((F.col("id") * 7919) % 30_011).alias("t"), "id")
    w = Window.partitionBy(*keys).orderBy("t")
    want = df.select("*", F.lag("id", 10_000).over(w).alias("a"), F.sum("id").over(w.rowsBetween(-10_000, 0)).alias("m"))
    got = o.lagged(df, keys, ["t"], {"a": "id"}, 10_000, rows_per_slice=1_500)
    got = o.moving(got, keys, ["t"], 10_000, {"m": F.sum("id")}, rows_per_slice=1_500)
    assert rows(got) == rows(want)


def test_sums_keep_their_type(spark, rows):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), "id", (F.col("id") / 4).cast("decimal(18,2)").alias("v"))
    want = o.with_running(df, ["k"], ["id"], {"s": F.col("v")})
    got = o.with_running(df, ["k"], ["id"], {"s": F.col("v")}, 20)
    assert got.schema["s"].dataType == want.schema["s"].dataType and rows(got) == rows(want)
