"""Reading, writing and laying out tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerkit.session import settle

CORRUPT = "_corrupt_record"


def load(spark: SparkSession, folder: str, name: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def rows_by_key(df: DataFrame, col: str, lo, hi=None) -> DataFrame:
    """Rows with one key, or with keys from ``lo`` to ``hi``; pushed to the scan."""
    return df.filter(F.col(col) == lo if hi is None else F.col(col).between(lo, hi))


def inline(spark: SparkSession, schema: str | T.StructType, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def structure_only(df: DataFrame) -> DataFrame:
    """An empty frame of the same columns (``SELECT … WHERE 1 = 0``)."""
    return df.limit(0)


def materialize(df: DataFrame, name: str, mode: str = "view", path: str | None = None) -> DataFrame:
    """``SELECT … INTO``: a session view, a view of all sessions, or a table."""
    if mode == "view":
        df.createOrReplaceTempView(name)
        return df
    if mode == "global":
        df.createOrReplaceGlobalTempView(name)
        return df
    writer = df.write.mode("overwrite")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def append_rows(df: DataFrame, path: str, keys: Sequence[str] = ()) -> DataFrame | None:
    """Append and, when asked, give the inserted keys. ``df`` must repeat itself when rerun."""
    df.write.mode("append").parquet(path)
    return df.select(*keys) if keys else None


def truncate(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Empty the table, keep its columns."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, sep: str = ",",
) -> tuple[DataFrame, DataFrame]:
    """Bulk load: the rows that fit the schema, and the raw text of those that do not.

    The parsed rows are settled first: read from the file directly, Spark would parse only the
    columns a later step asks for and take bad rows for good ones.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    raw = settle(spark.read.schema(wide).option("header", header).option("sep", sep).option(
        "mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    return raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), raw.filter(F.col(CORRUPT).isNotNull())


def load_log_files(spark: SparkSession, glob: str, kind: str = "text", schema=None) -> DataFrame:
    """Rolled log files by wildcard, each row with the file it came from."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if kind == "xml":
        reader = reader.option("rowTag", "event")
    return reader.format(kind).load(glob).withColumn("file", F.input_file_name())


def write_layout(
    df: DataFrame, path: str, partition_by: Sequence[str], sort_by: Sequence[str],
    rows_per_file: int = 5_000_000, mode: str = "overwrite",
) -> None:
    """Folders by the equality columns, files sorted by the range columns.

    The range shuffle runs over both, so a folder holding most of the rows is spread over many
    tasks; ``maxRecordsPerFile`` bounds the files.
    """
    arranged = df.repartitionByRange(*partition_by, *sort_by)
    arranged.sortWithinPartitions(*partition_by, *sort_by).write.mode(mode).option(
        "maxRecordsPerFile", rows_per_file
    ).partitionBy(*partition_by).parquet(path)


def write_lookup(
    df: DataFrame, path: str, sort_by: Sequence[str], bloom: Sequence[str] = (),
    group_bytes: int = 16 << 20, page_rows: int = 5_000, mode: str = "overwrite",
) -> None:
    """Files for reading few keys: sorted by ``sort_by``, with Bloom filters on other keys.

    A key of the sort order is found by the row groups' and pages' smallest and largest values, any key of
    ``bloom`` by its row group's filter; what cannot hold the key is not read. Small row groups and pages make
    the parts that are read small. The filters adapt to the number of values of a group.
    """
    writer = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by).write.mode(mode).option(
        "parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows)
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(
            f"parquet.bloom.filter.adaptive.enabled#{c}", "true")
    writer.parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table whose later joins on ``key`` need no shuffle. Not for a key with hot values."""
    writer = df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every table, in one job."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in tables.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
