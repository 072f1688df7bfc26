"""Helpers shared by the corpus operators: tables, key columns, labelled folds, work in chunks."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that a Python task works on at once; a longer single text makes a chunk alone.
CHUNK_BYTES = 1 << 20

# Bits of ``near_keys``: this many per key, up to a bound (16 MB in all). A bitmap of Spark holds 1 << 15 of them;
# fewer make more bitmaps (a multiple of 8).
BITS_PER_KEY, MOST_BITS, BITMAP_BITS = 32, 1 << 27, 1 << 15


# Rows that go to a Python task together. Texts are long, so fewer than Spark's default.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; also bounds the batches that Python tasks of the session receive."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, by ``modulus``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def near_keys(rows: DataFrame, column: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose ``column`` is probably among ``keys`` (one column, settled); ``left_anti``: the rows that surely are not.

    Each key sets one bit of a map that is broadcast, so wide rows are told apart where they lie. The map is of
    bounded size; other keys may meet a set bit, so an exact join has to follow. Null is never among the keys.
    """
    (key,) = keys.columns
    bits = BITMAP_BITS
    while bits < min(BITS_PER_KEY * keys.count(), MOST_BITS):
        bits *= 2
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    set_bits = keys.where(F.col(key).isNotNull()).select(place(F.col(key)).alias("_place")).groupBy(
        F.expr(f"_place div {BITMAP_BITS}").alias("_bitmap")).agg(
            F.bitmap_construct_agg(F.col("_place") % BITMAP_BITS).alias("_bits"))
    at = place(rows[column])
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at % BITMAP_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (at % 8).cast("int")) == 1
    return rows.join(F.broadcast(set_bits), (F.floor(at / BITMAP_BITS) == F.col("_bitmap")) & rows[column].isNotNull() & is_set, how)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of about ``limit`` bytes of text, each with its first row number."""
    start, size = 0, 0
    lengths = pc.binary_length(texts).to_pylist()
    for row, length in enumerate(lengths):
        if row > start and size + (length or 0) > limit:
            yield start, texts.slice(start, row - start)
            start, size = row, 0
        size += length or 0
    if start < len(lengths):
        yield start, texts.slice(start)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *caches: dict):
    """``run`` for a Python task that gives its memory back at its end.

    Spark keeps Python processes for later tasks, of other operators too: what one leaves in ``caches``, in
    Arrow's pool or in freed blocks of the C library would add up over the stages of a pipeline.
    """

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for cache in caches:
                cache.clear()
            release()

    return task


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
