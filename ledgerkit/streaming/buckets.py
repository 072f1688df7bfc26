"""Bucketed tables that take changes as deltas and are merged when they are read.

Layout below a table's path:

- ``base/batch=n/bucket=b``: all rows of a bucket as of batch n,
- ``delta/batch=n/bucket=b``: the last change of each key that batch n changed in the bucket,
- ``manifest/batch=n``: one row per live part of the table as of batch n, written last.

A batch writes the buckets it touches and nothing else. Readers follow one manifest, so they see a batch as a
whole or not at all, and older batches as long as their files are kept. A bucket with ``COMPACT_AFTER`` deltas
is merged into a new base. A repeated batch overwrites its own folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.operators.history import BEFORE, DELETE

BUCKETS = 64
COMPACT_AFTER = 8
MANIFEST = "bucket int, kind string, part long, buckets int"
_DELETED, _PART = "__deleted", "__part"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches that were written whole; lists folders only."""
    at, files = _files(spark, path + "/manifest")
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    whole = [n for n in names if n.startswith("batch=") and files.exists(_files(spark, f"{path}/manifest/{n}/_SUCCESS")[0])]
    return sorted(int(n.removeprefix("batch=")) for n in whole)


def manifest(spark: SparkSession, path: str, before: int | None = None) -> list:
    """Live parts of the newest batch, or the newest before ``before``."""
    numbers = [n for n in batches(spark, path) if before is None or n < before]
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/batch={numbers[-1]}").collect() if numbers else []


def write_manifest(spark: SparkSession, path: str, batch: int, live: Sequence[tuple]) -> None:
    """The last step of a batch: its parts are seen from now on."""
    spark.createDataFrame(live, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_parts(spark: SparkSession, path: str, parts: Sequence, kind: str, schema: T.StructType) -> DataFrame:
    """Rows of the listed parts of one kind, with their bucket and ``__part``; opens no other files."""
    found = sorted({(p["part"], p["bucket"]) for p in parts if p["kind"] == kind})
    if not found:
        return spark.createDataFrame([], T.StructType(
            [*schema.fields, T.StructField(_PART, T.LongType()), T.StructField("bucket", T.IntegerType())]))
    names = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(names).option("basePath", f"{path}/{kind}").parquet(
        *[f"{path}/{kind}/batch={n}/bucket={b}" for n, b in found]).withColumnRenamed("batch", _PART)


def write_parts(df: DataFrame, path: str, kind: str, batch: int) -> list[int]:
    """Write rows with their ``bucket`` as the parts of a batch; returns the buckets that got rows."""
    folder = f"{path}/{kind}/batch={batch}"
    # Balanced by Spark: a bucket that holds most rows is split over tasks.
    df.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
    at, files = _files(df.sparkSession, folder)
    names = [f.getPath().getName() for f in files.listStatus(at)]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def _read(spark: SparkSession, path: str, parts: Sequence, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The rows of the given parts, merged."""
    # Buckets go with their keys, so base and deltas of a key meet in one partition.
    delta = T.StructType([*schema.fields, T.StructField(_DELETED, T.BooleanType())])
    changed = read_parts(spark, path, parts, "delta", delta).groupBy("bucket", *keys).agg(
        F.max_by(F.struct(_DELETED, *schema.names), _PART).alias("l"))
    base = read_parts(spark, path, parts, "base", schema)
    rest = base.join(changed.select("bucket", *keys), ["bucket", *keys], "left_anti").select("bucket", *schema.names)
    return rest.unionByName(changed.filter(~F.col("l." + _DELETED)).select("bucket", *[F.col("l." + c).alias(c) for c in schema.names]))


def read(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], batch: int | None = None) -> DataFrame:
    """The table as of its newest batch, or as of ``batch``."""
    parts = manifest(spark, path, None if batch is None else batch + 1)
    return _read(spark, path, parts, schema, keys).drop("bucket")


def last_changes(feed: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The last change of each key, combined before the shuffle; ``__deleted`` says whether it removes the row."""
    last = feed.filter(F.col("op") != BEFORE).groupBy(*keys).agg(F.max_by(F.struct("op", *columns), "seq").alias("l"))
    return last.select(*[F.col("l." + c).alias(c) for c in columns], (F.col("l.op") == DELETE).alias(_DELETED))


def apply(feed: DataFrame, path: str, batch: int, keys: Sequence[str], columns: Sequence[str], buckets: int = BUCKETS) -> None:
    """Write a batch of changes (seq, op and the columns of the table)."""
    spark = feed.sparkSession
    before = manifest(spark, path, batch)
    buckets = before[0]["buckets"] if before else buckets  # a table keeps its number of buckets
    changes = last_changes(feed, keys, columns).withColumn("bucket", bucket_of(keys, buckets))
    touched = write_parts(changes, path, "delta", batch)
    live = [(p["bucket"], p["kind"], p["part"], buckets) for p in before] + [(b, "delta", batch, buckets) for b in touched]
    full = {b for b in touched if sum(p[0] == b and p[1] == "delta" for p in live) >= COMPACT_AFTER}
    if full:
        mine = [dict(zip(("bucket", "kind", "part"), p, strict=False)) for p in live if p[0] in full]
        written = write_parts(_read(spark, path, mine, feed.select(*columns).schema, keys), path, "base", batch)
        # A bucket whose rows were all deleted has no base.
        live = [p for p in live if p[0] not in full] + [(b, "base", batch, buckets) for b in written]
    write_manifest(spark, path, batch, live)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove parts that none of the newest ``keep`` batches reads, and older manifests; returns the parts removed."""
    numbers = batches(spark, path)
    kept = numbers[-keep:]
    live = {(p["kind"], p["part"], p["bucket"]) for n in kept
            for p in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/batch={n}").collect()}
    gone = 0
    for kind in ("base", "delta"):
        at, files = _files(spark, f"{path}/{kind}")
        for folder in files.listStatus(at) if files.exists(at) else []:
            name = folder.getPath().getName()
            # Folders of batches after the newest manifest may be in the middle of being written.
            if not name.startswith("batch=") or not kept or int(name.removeprefix("batch=")) > kept[-1]:
                continue
            for entry in files.listStatus(folder.getPath()):
                part = entry.getPath().getName()
                if part.startswith("bucket=") and (kind, int(name.removeprefix("batch=")), int(part.removeprefix("bucket="))) not in live:
                    files.delete(entry.getPath(), True)
                    gone += 1
    for n in numbers[:-keep]:
        at, files = _files(spark, f"{path}/manifest/batch={n}")
        files.delete(at, True)
    return gone
