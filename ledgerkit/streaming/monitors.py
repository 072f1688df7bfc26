"""Stream forms of the monitors and feeds. Every function takes and gives streaming frames, or
starts a query with a checkpoint folder given by the caller."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ledgerkit.functions.exprs import date_diff
from ledgerkit.operators import ordered
from ledgerkit.streaming import buckets


def read_files(spark: SparkSession, path: str, schema: T.StructType, per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; zone-less times become timestamps for watermarks."""
    reader = spark.readStream.schema(schema)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    df = reader.parquet(path)
    zoneless = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything available now into Parquet files, exactly once."""
    return stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def slow_monitor(stream: DataFrame, ms: int, path: str, checkpoint: str) -> StreamingQuery:
    """Keep events that took at least ``ms`` milliseconds."""
    return to_files(stream.filter(F.col("duration") >= ms), path, checkpoint)


def frequency_stream(
    stream: DataFrame, length: str, slide: str | None, watermark: str, n: int, key: str = "account_id",
) -> DataFrame:
    """Keys with at least ``n`` events in a window; later events than the watermark are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = stream.withWatermark("ts", watermark).groupBy(window.alias("w"), key).agg(
        F.count(F.lit(1)).alias("operations"))
    return counted.filter(F.col("operations") >= n).select(
        key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "operations")


def activity_stream(stream: DataFrame, length: str, watermark: str, keys: Sequence[str] = ()) -> DataFrame:
    """Events and amounts per hour or day (``length``) and key."""
    out = stream.withWatermark("ts", watermark).groupBy(F.window("ts", length).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("events"), F.sum("amount").alias("amount"))
    return out.select(F.col("w.start").alias("start"), *keys, "events", "amount")


def session_stream(stream: DataFrame, gap: str, watermark: str, key: str = "account_id") -> DataFrame:
    """Sessions: runs of events of a key with no pause of ``gap`` or longer."""
    out = stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


class LateRows(StreamingQueryListener):
    """Counts the rows that each query dropped behind its watermark, over its whole run.

    Add it to ``spark.streams`` before the query starts.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event):  # noqa: N802
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event):  # noqa: N802
        run = str(event.progress.runId)
        late = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.dropped[run] = self.dropped.get(run, 0) + late

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass

    def rows(self, query: StreamingQuery) -> int:
        return self.dropped.get(str(query.runId), 0)


STATE_BUCKETS = 64
FULL_EVERY = 50  # parts of a bucket of the state after which they are written together


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp"))


def _since(rows: DataFrame, mark: int | None, key: str, tie: str) -> DataFrame:
    """The rows from ``mark`` on, and of those before it the last of each key."""
    if mark is None:
        return rows
    old = ordered.latest(rows.filter(_micros() < mark), [key], ["ts", tie])
    return rows.filter(_micros() >= mark).unionByName(old)


def cdc_stream(
    feed: DataFrame, path: str, checkpoint: str, keys: Sequence[str], columns: Sequence[str],
    per_table: int = buckets.BUCKETS,
) -> StreamingQuery:
    """Apply a change feed (seq, op and the columns) to a bucketed table; ``buckets.read`` reads it.

    A batch writes the last change of each of its keys to the buckets they belong to; the other buckets keep
    their files. Rerunning a batch gives the same table.
    """

    def apply(changes: DataFrame, batch: int) -> None:
        buckets.apply(changes, path, batch, keys, columns, per_table)

    return feed.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def travel_stream(
    stream: DataFrame, path: str, checkpoint: str, key: str = "account_id", place: str = "place",
    minutes: int = 30, tie: str = "event_id", lateness: timedelta = timedelta(days=1),
) -> StreamingQuery:
    """Impossible travel across batches; ``travel_alerts`` reads the result.

    The watermark of a batch is the largest time of the batches before it less ``lateness``. The state
    holds the rows from the watermark on and the last row of each key before it, so a late row meets both
    its neighbours. It lies in buckets by key, and a batch opens the buckets of its own keys only. A batch is put
    between the kept rows of its keys and searched with the sliced lag, so a
    key that fills most of a batch is still spread over tasks; pairs with a new row on either side are
    reported. A late row parts two rows that were a pair before: the later row's key and ``tie`` are
    written to ``parted``, which takes its alerts of earlier batches back. Rows before the watermark cannot
    be placed; they are written to ``late``, none is lost. Rows without a time have no pairs. A batch
    adds a part to each of its buckets; ``FULL_EVERY`` parts of a bucket become one.
    """
    slack = lateness // timedelta(microseconds=1)
    alerts, parted, late, state = (f"{path}/{n}" for n in ("alerts", "parted", "late", "last"))
    names = [key, "ts", place, tie]

    def search(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.select(*names).filter("ts is not null").persist()
        try:
            live = buckets.manifest(spark, state, batch)
            newest = max((p["part"] for p in live if p["kind"] == "newest"), default=None)
            live = [p for p in live if p["kind"] != "newest"]
            mark = None if newest is None else newest - slack
            on_time = rows if mark is None else rows.filter(_micros() >= mark)
            bucket = buckets.bucket_of([key], STATE_BUCKETS)
            mine = {r[0] for r in on_time.select(bucket).distinct().collect()}
            touched = [p for p in live if p["bucket"] in mine]
            known = buckets.read_parts(spark, state, touched, "rows", rows.schema).select(*names)
            known = _since(known, mark, key, tie)
            met = known.join(on_time.select(key).distinct(), key, "left_semi")
            fresh = on_time.withColumn("__new", F.lit(True)).unionByName(met.withColumn("__new", F.lit(False)))
            seen = ordered.lagged(fresh, [key], ["ts", tie], {
                "previous_place": place, "previous_ts": "ts", "__new_before": "__new"}).persist()
            try:
                gap = date_diff("minute", "previous_ts", "ts")
                hit = (F.col("__new") | F.col("__new_before")) & (F.col(place) != F.col("previous_place")) & (gap < minutes)
                seen.filter(hit).drop("__new", "__new_before").write.mode("overwrite").parquet(f"{alerts}/batch={batch}")
                seen.filter(~F.col("__new") & F.col("__new_before")).select(key, tie).write.mode("overwrite").parquet(
                    f"{parted}/batch={batch}")
            finally:
                seen.unpersist()
            (rows.limit(0) if mark is None else rows.filter(_micros() < mark)).write.mode("overwrite").parquet(
                f"{late}/batch={batch}")
            full = {b for b in mine if sum(p["bucket"] == b for p in touched) + 1 >= FULL_EVERY}
            kept = on_time.unionByName(known.filter(bucket.isin(*full))) if full else on_time
            latest = on_time.agg(F.max(_micros())).first()[0]
            latest = max((t for t in (latest, newest) if t is not None), default=None)
            kept = _since(kept, None if latest is None else latest - slack, key, tie)
            written = buckets.write_parts(kept.withColumn("bucket", bucket), state, "rows", batch)
            now = [(p["bucket"], "rows", p["part"], STATE_BUCKETS) for p in live if p["bucket"] not in full]
            now += [(b, "rows", batch, STATE_BUCKETS) for b in written]
            if latest is not None:
                now.append((-1, "newest", latest, STATE_BUCKETS))
            buckets.write_manifest(spark, state, batch, now)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(search).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def travel_alerts(spark: SparkSession, path: str, key: str = "account_id", tie: str = "event_id") -> DataFrame:
    """The alerts of ``travel_stream`` that no late row took back."""
    found = spark.read.parquet(f"{path}/alerts")
    gone = spark.read.parquet(f"{path}/parted").groupBy(key, tie).agg(F.max("batch").alias("__parted"))
    standing = found.join(gone, [key, tie], "left").filter("__parted is null or batch >= __parted")
    return standing.select(*found.columns).drop("batch")
