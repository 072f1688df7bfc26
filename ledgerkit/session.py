"""Spark session settings and the two helpers that cut lineage or give a path for tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime settings every job relies on. They are SQL settings, so they can be applied to a
# session somebody else built.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even when that costs one more shuffle further down.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Merge the sessions of a busy key on the map side before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


_scratch: list[list[str]] = []


def build(app: str = "ledgerkit", master: str | None = None, **conf: str) -> SparkSession:
    """A session for scripts and tests. On a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in RUNTIME.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a temporary one only on a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        configured = tempfile.mkdtemp(prefix="ledgerkit-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read it from there afterwards.

    Used where a frame feeds several jobs or a loop. The copy outlives lost executors, cuts the
    lineage, and, being Parquet, later jobs read only the columns they need. A copy stays until
    ``discard`` or the end of the ``scratch`` block it was made in.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch:
        _scratch[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself when it is a settled copy already."""
    return df if getattr(df, "_settled_path", None) else settle(df)


def discard(*frames: DataFrame | None) -> None:
    """Remove settled copies that nothing reads any more, as in a loop; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_settled_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove all copies made inside at its end. Results that read them are written before that."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def has_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
