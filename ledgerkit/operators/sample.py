"""Samples that depend on keys and a seed alone, so they repeat on any cluster and in any order of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.operators.ordered import null_safe_join, number_rows


def keyed_number(seed: int | str, *cols: str) -> Column:
    """A number below 2**60 from the columns' text and the seed: the first fifteen digits of an MD5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def stratified(df: DataFrame, strata: Sequence[str], key: Sequence[str], share: float, seed: int | str = 0) -> DataFrame:
    """Exactly ``ceil(share * n)`` rows of each stratum's n: those with the smallest keyed numbers.

    ``key`` identifies a row. A larger share with the same seed contains the smaller one. A stratum that
    holds most rows is numbered in slices.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    numbered = number_rows(df.withColumn("__keyed", keyed_number(seed, *key)), strata, ["__keyed", *key], "__rn")
    sizes = df.groupBy(*strata).agg(F.ceil(F.count(F.lit(1)) * F.lit(share)).alias("__take"))
    if strata:
        numbered = null_safe_join(numbered, sizes, strata, "inner")
    else:
        numbered = numbered.withColumn("__take", sizes.select("__take").scalar())
    return numbered.filter(F.col("__rn") <= F.col("__take")).select(*df.columns)
