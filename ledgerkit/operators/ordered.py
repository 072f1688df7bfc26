"""Ordered calculations (numbering, running totals, lags, ranks, percentiles, pages).

A Spark window sends each ``partitionBy`` group to one task, and a window without keys sends
everything to one task. That is fine while groups are small. One key may hold a third of all
rows, so every function here first counts the rows of the largest key. Above ``rows_per_slice`` the
calculation becomes a prefix scan:

1. the rows are range-partitioned by keys, all sort columns and their place in the input, so any
   number and type of sort columns, and even equal rows, can be cut; a range is a slice,
2. per key and slice a small aggregate (a sum, a count, the last n rows) is made, and what the
   earlier slices of the key give is added to the slice as rows before its own,
3. the window itself runs per key and slice.

Only keys that a border cuts have anything to carry: at most one key per border. The slices decide
where rows are worked on, never which rows are in the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ledgerkit.session import settle

ROWS_PER_SLICE = 2_000_000
GROUP_LIMIT = 1_000  # Spark's default bound for limiting groups before the shuffle

_SLICE, _OWN, _PLACE = "__slice", "__own", "__place"


@dataclass(frozen=True)
class Layout:
    """A frame with a slice column, and the slices of the keys that were cut.

    ``pieces`` has the keys, the slice, its rows ``__n`` and the key's rows before it ``__before``. It
    is None when no key needed cutting.
    """

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    pieces: DataFrame | None = None

    @property
    def sliced(self) -> bool:
        return self.pieces is not None

    def window(self) -> WindowSpec:
        """Within a slice; what is carried into it (``__own`` 0) comes first."""
        if not self.sliced:
            return Window.partitionBy(*self.keys).orderBy(*sort_columns(self.order))
        return Window.partitionBy(*self.keys, _SLICE).orderBy(_OWN, *sort_columns(self.order))

    def with_carried(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        return rows.withColumn(_OWN, F.lit(1)).unionByName(
            carried.withColumn(_OWN, F.lit(0)), allowMissingColumns=True)


def column_name(item: str) -> str:
    return item[1:] if item.startswith("-") else item


def sort_columns(order: Sequence[str], flip: bool = False) -> list[Column]:
    """``"x"`` sorts ascending with nulls first, ``"-x"`` descending with nulls last."""
    out = []
    for item in order:
        descending = item.startswith("-") != flip
        col = F.col(column_name(item))
        out.append(col.desc_nulls_last() if descending else col.asc_nulls_first())
    return out


def flipped(order: Sequence[str]) -> list[str]:
    return [item[1:] if item.startswith("-") else "-" + item for item in order]


def _sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key, and all rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = counts.agg(F.max("n"), F.sum("n")).first()
    return largest or 0, total or 0


def _is_scan(df: DataFrame) -> bool:
    """Whether reading the frame again costs no more than a scan of files."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() in ("Project", "Filter"):
        node = node.children().head()
    return node.getClass().getSimpleName() in ("LogicalRelation", "InMemoryRelation")


def layout(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    rows_per_slice: int | None = None, size: int | None = None,
) -> Layout:
    """Cut the rows of ``df`` along keys and ``order`` when a key is too large. A known ``size`` may save the counting."""
    rows_per_slice = rows_per_slice or ROWS_PER_SLICE
    plain = Layout(df, tuple(keys), tuple(order))
    if size is not None and size <= rows_per_slice:
        return plain
    largest, total = _sizes(df, keys)
    if largest <= rows_per_slice:
        return plain
    # Sampling the borders and cutting read the rows once more each.
    source = df if _is_scan(df) else settle(df)
    ranged = source.withColumn(_PLACE, F.monotonically_increasing_id()).repartitionByRange(
        math.ceil(total / rows_per_slice), *[F.col(k).asc_nulls_first() for k in keys], *sort_columns(order), F.col(_PLACE).asc())
    out = settle(ranged.drop(_PLACE).withColumn(_SLICE, F.spark_partition_id()))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    pieces = out.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("__n"))
    pieces = pieces.withColumn("__slices", F.count(F.lit(1)).over(by_key)).filter("__slices > 1").withColumn(
        "__before", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long"))).drop("__slices")
    return Layout(out, tuple(keys), tuple(order), settle(pieces))


def with_running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column],
    rows_per_slice: int | None = None, size: int | None = None,
) -> DataFrame:
    """Running sums up to and including the row (``ROWS UNBOUNDED PRECEDING``)."""
    laid = layout(df, keys, order, rows_per_slice, size)
    return _running(laid, sums)


def _running(laid: Layout, sums: Mapping[str, Column]) -> DataFrame:
    frame = laid.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not laid.sliced:
        return laid.df.withColumns({n: F.sum(c).over(frame) for n, c in sums.items()})
    rows = laid.df.withColumns({"__v_" + n: c for n, c in sums.items()})
    values = ["__v_" + n for n in sums]
    partial = rows.groupBy(*laid.keys, _SLICE).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy(*laid.keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = null_safe_join(partial, laid.pieces.select(*laid.keys, _SLICE), [*laid.keys, _SLICE], "inner").select(
        *laid.keys, _SLICE, *[F.sum(v).over(before).alias(v) for v in values])
    kinds = laid.df.select(*[F.sum(c).alias(n) for n, c in sums.items()]).schema
    out = laid.with_carried(rows, carried).withColumns(
        {n: F.sum("__v_" + n).over(frame).cast(kinds[n].dataType) for n in sums})
    return out.filter(F.col(_OWN) == 1).drop(_OWN, _SLICE, *values)


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """``ROW_NUMBER``; without keys the numbering is global and still spread over tasks."""
    laid = layout(df, keys, order, rows_per_slice)
    if not laid.sliced:
        return df.withColumn(name, F.row_number().over(laid.window()).cast("long"))
    return _running(laid, {name: F.lit(1).cast("long")})


def with_preceding(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
    exprs: Mapping[str, Callable[[WindowSpec], Column]], rows_per_slice: int | None = None,
) -> DataFrame:
    """Window expressions that look back at most ``n`` rows (lags, moving frames).

    Each slice is given the ``n`` rows before it as extra rows, dropped again at the end: the last
    n rows of each slice are numbered and joined to the slices within reach.
    Flip ``order`` to look ahead.
    """
    laid = layout(df, keys, order, rows_per_slice)
    if not laid.sliced:
        return df.withColumns({name: fn(laid.window()) for name, fn in exprs.items()})
    n = max(n, 1)
    back = Window.partitionBy(*keys, _SLICE).orderBy(*sort_columns(order, flip=True))
    tails = null_safe_join(laid.df, laid.pieces, [*keys, _SLICE], "inner").withColumn(
        "__back", F.row_number().over(back)).filter(F.col("__back") <= n)
    # Places within the key, in buckets of n: the n rows before a slice lie in two of them.
    place = F.col("__before") + F.col("__n") - F.col("__back") + 1
    tails = tails.select(*df.columns, place.alias("__at"), F.floor(place / n).alias("__bucket"))
    first, last = F.greatest(F.col("__before") - n + 1, F.lit(1)), F.col("__before")
    takers = laid.pieces.filter("__before > 0").select(
        *keys, _SLICE, first.alias("__from"), last.alias("__to"),
        F.explode(F.array_distinct(F.array(F.floor(first / n), F.floor(last / n)))).alias("__bucket"))
    halo = null_safe_join(tails, takers, [*keys, "__bucket"], "inner").filter("__at between __from and __to").select(
        *df.columns, _SLICE)
    out = laid.with_carried(laid.df, halo).withColumns({name: fn(laid.window()) for name, fn in exprs.items()})
    return out.filter(F.col(_OWN) == 1).drop(_OWN, _SLICE)


def lagged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str],
    offset: int = 1, rows_per_slice: int | None = None,
) -> DataFrame:
    """``LAG``: new column -> source column. Null where there is no earlier row."""
    exprs = {
        new: (lambda w, c=old: F.lag(c, offset).over(w)) for new, old in columns.items()
    }
    return with_preceding(df, keys, order, offset, exprs, rows_per_slice)


def led(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str],
    offset: int = 1, rows_per_slice: int | None = None,
) -> DataFrame:
    """``LEAD``; over sliced keys as a lag in the opposite order."""
    if _sizes(df, keys)[0] <= (rows_per_slice or ROWS_PER_SLICE):
        w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        return df.withColumns({new: F.lead(old, offset).over(w) for new, old in columns.items()})
    return lagged(df, keys, flipped(order), columns, offset, rows_per_slice)


def moving(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int,
    aggs: Mapping[str, Column], rows_per_slice: int | None = None,
) -> DataFrame:
    """Aggregates over the row and the ``n`` rows before it."""
    exprs = {name: (lambda w, a=agg: a.over(w.rowsBetween(-n, 0))) for name, agg in aggs.items()}
    return with_preceding(df, keys, order, n, exprs, rows_per_slice)


def with_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rank: str | None = None,
    dense: str | None = None, percent: str | None = None, rows_per_slice: int | None = None,
    source: DataFrame | None = None, size: int | None = None,
) -> DataFrame:
    """``RANK``, ``DENSE_RANK`` and ``PERCENT_RANK`` by one value (``"-x"`` ranks downwards).

    Where a group is too large for one task the ranks come from the counts per distinct value,
    so any number of ties stays one row until the final join. ``source`` may name a cheaper
    frame with the same keys and values to count on.
    """
    source = df if source is None else source
    name = column_name(value)
    limit = rows_per_slice or ROWS_PER_SLICE
    if (_sizes(source, keys)[0] if size is None else size) <= limit:
        w = Window.partitionBy(*keys).orderBy(*sort_columns([value]))
        wanted = {rank: F.rank(), dense: F.dense_rank(), percent: F.percent_rank()}
        return df.withColumns({
            n: (fn.over(w) if n == percent else fn.over(w).cast("long"))
            for n, fn in wanted.items() if n
        })
    counts = settle(source.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("__n")))
    table = with_running(
        counts, keys, [value], {"__upto": F.col("__n"), "__dense": F.lit(1).cast("long")},
        rows_per_slice,
    )
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    if keys:
        table = null_safe_join(table, totals, keys, "inner")
    else:
        table = table.withColumn("__all", totals.select("__all").scalar())
    position = F.col("__upto") - F.col("__n") + 1
    share = F.when(F.col("__all") > 1, (position - 1) / (F.col("__all") - 1)).otherwise(F.lit(0.0))
    picked = [(rank, position), (dense, F.col("__dense")), (percent, share)]
    table = table.select(*keys, name, *[c.alias(n) for n, c in picked if n])
    return null_safe_join(df, table, [*keys, name], "inner")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join that also matches null keys; the right key columns are dropped."""
    renamed = right.withColumnsRenamed({k: "__r_" + k for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed["__r_" + k])
    return left.join(renamed, on, how).drop(*["__r_" + k for k in keys])


def with_ntile(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], tiles: int, name: str = "tile",
    rows_per_slice: int | None = None,
) -> DataFrame:
    """``NTILE``: the first groups take one row more when the rows do not divide evenly."""
    laid = layout(df, keys, order, rows_per_slice)
    if not laid.sliced:
        return df.withColumn(name, F.ntile(tiles).over(laid.window()).cast("long"))
    numbered = _running(laid, {"__rn": F.lit(1).cast("long")})
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"))
    if keys:
        numbered = null_safe_join(numbered, totals, keys, "inner")
    else:
        numbered = numbered.withColumn("__all", totals.select("__all").scalar())
    rn, base, extra = F.col("__rn"), F.expr(f"__all div {tiles}"), F.col("__all") % tiles
    wide = extra * (base + 1)
    early = F.floor((rn - 1) / (base + 1)) + 1
    late = extra + F.floor((rn - wide - 1) / F.greatest(base, F.lit(1))) + 1
    tile = F.when(rn <= wide, early).otherwise(late).cast("long")
    return numbered.withColumn(name, tile).drop("__rn", "__all")


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
    rows_per_slice: int | None = None,
) -> DataFrame:
    """``PERCENTILE_CONT`` per key: exact, interpolated, from the counts per distinct value."""
    counts = settle(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("__n")
    ))
    table = with_running(counts, keys, [value], {"__upto": F.col("__n")}, rows_per_slice)
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    if keys:
        table = null_safe_join(table, totals, keys, "inner")
    else:
        table = table.withColumn("__all", totals.select("__all").scalar())
    aggs, outs = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("__all") - 1)
        low, high = F.floor(at), F.ceil(at)
        number = F.col(value).cast("double")
        aggs += [
            F.min(F.when(F.col("__upto") > low, number)).alias("__lo_" + name),
            F.min(F.when(F.col("__upto") > high, number)).alias("__hi_" + name),
            F.max(at - low).alias("__f_" + name),
        ]
        lo, hi, part = F.col("__lo_" + name), F.col("__hi_" + name), F.col("__f_" + name)
        outs.append((lo + part * (hi - lo)).alias(name))
    return table.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def first_last(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
    first: str = "first_value", last: str = "last_value",
) -> DataFrame:
    """``FIRST_VALUE`` and ``LAST_VALUE`` over the whole group, by a map-side combined pick."""
    position = F.struct(*[column_name(o) for o in order])
    if any(o.startswith("-") for o in order):
        raise ValueError("give an ascending order; swap first and last for a descending one")
    ends = df.groupBy(*keys).agg(
        F.min_by(value, position).alias(first), F.max_by(value, position).alias(last)
    )
    return null_safe_join(df, ends, keys, "inner")


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, name: str = "rn",
) -> DataFrame:
    """The first ``n`` rows of each key.

    Spark limits each key to ``n`` rows before the shuffle, so a hot key arrives as n rows per
    map task.
    """
    if n > GROUP_LIMIT:
        return number_rows(df, keys, order, name).filter(F.col(name) <= n)
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n).withColumn(
        name, F.col(name).cast("long")
    )


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row per key by an ascending order (ties need a further sort column)."""
    whole = F.struct(*df.columns)
    picked = df.groupBy(*keys).agg(
        F.max_by(whole, F.struct(*[column_name(o) for o in order])).alias("r")
    )
    return picked.select("r.*")
