"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Count the rows of every input partition (the driver receives one number per partition).
2. Draw how many rows each partition sends to each shard from the multivariate hypergeometric
   distribution; all column sums are the exact shard sizes, at most one row apart. The draw goes down a binary tree over
   the partitions, with a seed per node, so a task draws its own row of the matrix from the counts alone and
   the whole matrix is nowhere.
3. Each partition permutes its share of shard labels over its rows and draws a random key per row.
4. One exchange by (shard, range of keys) brings the rows together; their order by key is the second
   permutation. The sizes of the ranges follow from the seed and the counts alone, so Spark sums them
   without reading a row again, and a row's slot is its range's start plus its rank there.

A range holds about ``RANGE_ROWS`` rows whatever the input, so no task sorts a whole shard. All
draws depend on (seed, partition) only: a task that runs again gives the same rows the same places.
That needs an input whose partitions come out alike each time (a scan does); a partition whose row
count differs from the first count fails the job instead of giving wrong sizes.

Defined results: null or empty texts, repeated rows and any further columns are carried as they
are; an empty table gives no rows; fewer rows than shards leave some shards empty. The added
columns' names must be free, else an error says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.operators.ordered import with_running
from ledgerkit.session import settle

RANGE_ROWS = 20_000
BLOCK = 65_536  # rows whose labels are drawn together


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart that sum to ``rows``."""
    return np.array([rows // shards + (k < rows % shards) for k in range(shards)], np.int64)


def matrix_row(before: np.ndarray, sizes: np.ndarray, seed: int, partition: int) -> np.ndarray:
    """How many of a partition's rows go to each shard. ``before`` has the rows before each partition, and all rows last.

    Each node of the tree splits its rows of every shard between its halves.
    """
    low, high, left = 0, len(before) - 1, sizes.copy()
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.PCG64([seed, 0, low, high]))
        first = draw(rng, left, int(before[middle] - before[low]))
        if partition < middle:
            high, left = middle, first
        else:
            low, left = middle, left - first
    return left


def draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """``n`` draws without replacement from ``left`` rows of each kind."""
    out = np.zeros_like(left)
    rest = int(left.sum())
    for k, m in enumerate(left):
        rest -= int(m)
        if n == 0:
            break
        out[k] = rng.hypergeometric(int(m), rest, n) if m and rest else (n if not rest else 0)
        n -= int(out[k])
    return out


def assignments(row: np.ndarray, seed: int, partition: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (shard, 63-bit key) for one partition's rows, in row order."""
    rng = np.random.Generator(np.random.PCG64([seed, 1, partition]))
    left = row.copy()
    while left.any():
        part = draw(rng, left, min(BLOCK, int(left.sum())))
        left -= part
        labels = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), part))
        yield labels, rng.integers(0, 1 << 62, len(labels), dtype=np.int64)


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return np.minimum((keys.astype(np.float64) / float(1 << 62) * ranges).astype(np.int64), ranges - 1)


def shuffle(df: DataFrame, shards: int, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    taken = {"shard", "slot", "_range", "_key"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are in the input already")
    spark = df.sparkSession
    counted = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    total = sum(r["count"] for r in counted)
    # One number per partition; the tasks get this list and nothing else.
    n_parts = max((r["p"] for r in counted), default=-1) + 1
    counts = np.zeros(n_parts, np.int64)
    for r in counted:
        counts[r["p"]] = r["count"]
    before, whole = np.concatenate([[0], np.cumsum(counts)]), shard_sizes(total, shards)
    ranges = max(1, -(-total // shards // range_rows))
    sent = spark.sparkContext.broadcast(before)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                for labels, keys in assignments(matrix_row(sent.value, whole, seed, p), seed, p):
                    used, n = np.unique(labels.astype(np.int64) * ranges + range_of(keys, ranges), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n)], ["_range", "n"])

    drawn = spark.range(0, n_parts, 1, max(1, min(n_parts, 200))).mapInArrow(sizes, "_range long, n long")
    per_range = settle(drawn.groupBy("_range").agg(F.sum("n").alias("n")).withColumn("_of", F.floor(F.col("_range") / ranges)))
    start = settle(with_running(per_range, ["_of"], ["_range"], {"_upto": F.col("n")}).select(
        "_range", (F.col("_upto") - F.col("n")).alias("_start")))

    schema = T.StructType([*df.schema.fields, *T.StructType.fromDDL("shard int, _range long, _key long").fields])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        row = matrix_row(sent.value, whole, seed, p) if p < n_parts else np.zeros(shards, np.int64)
        blocks = assignments(row, seed, p)
        labels, keys = np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            n = batch.num_rows
            while len(labels) < n:
                block = next(blocks, None)
                if block is None:
                    raise RuntimeError(f"partition {p} has more rows than were counted")
                labels, keys = np.concatenate([labels, block[0]]), np.concatenate([keys, block[1]])
            own = labels[:n].astype(np.int64) * ranges + range_of(keys[:n], ranges)
            columns = [*batch.columns, pa.array(labels[:n]), pa.array(own), pa.array(keys[:n])]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema.fields])
            labels, keys = labels[n:], keys[n:]
        if len(labels) or next(blocks, None) is not None:
            raise RuntimeError(f"partition {p} has fewer rows than were counted")

    placed = df.mapInArrow(place, schema)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    return (
        placed.withColumn("_rank", rank).join(F.broadcast(start) if shards * ranges <= 1_000_000 else start, "_range")
        .withColumn("slot", F.col("_start") + F.col("_rank") - 1)
        .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
    )
