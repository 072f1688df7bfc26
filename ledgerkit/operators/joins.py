"""Joins. Broadcasting is left to Spark, which checks sizes at run time, unless a size is proven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerkit.operators import ordered
from ledgerkit.session import discard, settle
from ledgerkit.sources.bank import Bank



def bank_star(bank: Bank) -> DataFrame:
    """Each transaction with its account and client."""
    accounts = bank.accounts.select(
        "account_id", "client_id", F.col("state").alias("account_state"),
        F.col("type").alias("account_type"), "balance",
    )
    clients = bank.clients.select("client_id", "name", "segment", "branch_id")
    return bank.tx.join(accounts, "account_id").join(clients, "client_id")


def keys_of(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The distinct keys, combined on the map side: a hot key arrives as one row per map task."""
    return df.select(*([on] if isinstance(on, str) else on)).distinct()


def left_many(left: DataFrame, right: DataFrame, on: str, listed: DataFrame | None = None) -> DataFrame:
    """Left join to a side with many rows per key.

    Spark can split a hot key of the many side in an inner join, not as the right of an outer
    join. So this is the inner join and the left rows without a partner. ``listed`` may name a
    cheaper frame with the same keys as ``right``.
    """
    alone = left.join(keys_of(right if listed is None else listed, on), on, "left_anti")
    return left.join(right, on).unionByName(alone, allowMissingColumns=True)


def left_in_period(left: DataFrame, right: DataFrame, on: str, when: Column) -> DataFrame:
    """Left join with a condition on the right side: every left row stays."""
    return left_many(left, right.filter(when), on)


def with_lookups(df: DataFrame, lookups: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Left joins to lookup tables: (table, column of ``df``, key of the table, prefix).

    The same table may appear more than once under different prefixes.
    """
    for table, column, key, prefix in lookups:
        renamed = table.select(*[F.col(c).alias(prefix + c) for c in table.columns])
        df = df.join(renamed, F.col(column) == F.col(prefix + key), "left").drop(prefix + key)
    return df


def having_any(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(keys_of(right, on), on, "left_semi")


def without_any(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return left.join(keys_of(right, on), on, "left_anti")


def having_any_by_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The same rows as ``having_any`` by a plain join to the distinct keys."""
    return left.join(right.select(on).distinct(), on)


def not_in(left: DataFrame, col: str, right: DataFrame, key: str) -> DataFrame:
    """SQL ``NOT IN`` with its null rules, as an ordinary anti join.

    A null in the list leaves no row, a null on the left is dropped unless the list is empty.
    """
    listed = right.select(F.col(key).alias("__key"))
    facts = listed.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__key").isNull()).alias("nulls")
    )
    kept = left.join(
        listed.filter(F.col("__key").isNotNull()).distinct(), F.col(col) == F.col("__key"), "left_anti"
    )
    size, nulls = facts.select("n").scalar(), facts.select("nulls").scalar()
    return kept.filter((size == 0) | ((nulls == 0) & F.col(col).isNotNull()))


def is_in(left: DataFrame, col: str, right: DataFrame, key: str) -> DataFrame:
    listed = right.select(F.col(key).alias("__key")).distinct()
    return left.join(listed, F.col(col) == F.col("__key"), "left_semi")


def duplicate_pairs(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Each duplicate with the first row of the same key.

    n rows of one key give n - 1 pairs; the other pairs follow from these.
    """
    first = df.groupBy(*keys).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))
    repeated = first.filter(F.col("copies") > 1)
    pairs = df.select(*keys, F.col(id_col).alias("duplicate_id")).join(repeated, [*keys])
    return pairs.filter(F.col("duplicate_id") != F.col("first_id"))


def prefix_pairs(df: DataFrame, col: str, sep: str = ",") -> DataFrame:
    """Pairs of distinct lists where one starts with the whole of the other (``b LIKE a + ',%'``).

    Every list is expanded to its own proper prefixes, so the theta join is an equi-join.
    """
    lists = df.select(F.col(col).alias("longer")).distinct()
    parts = F.split("longer", F.concat(F.lit("\\Q"), F.lit(sep), F.lit("\\E")))
    cut = F.transform(
        F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), sep),
    )
    prefixes = lists.select("longer", F.explode(cut).alias("shorter"))
    return prefixes.join(lists.select(F.col("longer").alias("shorter")), "shorter", "left_semi")


def top_n_per(
    left: DataFrame, right: DataFrame, key: str, order: Sequence[str], n: int, outer: bool = False,
) -> DataFrame:
    """``CROSS APPLY`` (or ``OUTER APPLY``) of the first ``n`` right rows of each left row."""
    best = ordered.top_per_group(right, [key], order, n)
    return left.join(best, key, "left" if outer else "inner")


def hinted_join(
    a: DataFrame, b: DataFrame, on: str | Sequence[str], strategy: str, how: str = "inner",
) -> DataFrame:
    """Join with a chosen strategy. ``loop`` is left to Spark, which ships a small side to all tasks.

    ``hash`` builds a table of one side's partition in memory, so ``b`` must be the smaller side.
    """
    if strategy == "loop":
        return a.join(b, on, how)
    return a.join(b.hint({"hash": "shuffle_hash", "merge": "merge"}[strategy]), on, how)


def by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in a list handed over as a table."""
    return df.join(keys_of(ids, key), key, "left_semi")


def hierarchy(df: DataFrame, id_col: str, parent: str) -> DataFrame:
    """Level (roots 1) and root of every node under a root.

    Each round replaces a node's known ancestor by that ancestor's own, so the number of rounds
    is the logarithm of the depth. Orphans and cycles never reach a root and are left out.
    """
    # The pointer of a node: some ancestor, and how many steps up it is.
    nodes = df.select(
        F.col(id_col).alias("id"), F.col(parent).alias("up"),
        F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("steps"),
        F.when(F.col(parent).isNull(), F.col(id_col)).alias("root"),
    )
    nodes = settle(nodes)
    total = nodes.count()
    waiting, span = nodes.filter("root IS NULL").count(), 1
    while waiting and span <= total:
        above = nodes.select(
            F.col("id").alias("up"), F.col("up").alias("next_up"),
            F.col("steps").alias("more"), F.col("root").alias("next_root"),
            F.lit(True).alias("known"),
        )
        climbing = nodes.filter("root IS NULL").join(above, "up", "left")
        moved = climbing.filter("known").select(
            "id", F.coalesce("next_up", "up").alias("up"),
            (F.col("steps") + F.col("more")).alias("steps"), F.col("next_root").alias("root"),
        )
        # Nodes under a missing parent drop out here; nodes in a cycle wait until the end.
        before, nodes = nodes, settle(nodes.filter("root IS NOT NULL").unionByName(moved))
        discard(before)
        waiting, span = nodes.filter("root IS NULL").count(), span * 2
    return nodes.filter("root IS NOT NULL").select(
        F.col("id").alias(id_col), "root", (F.col("steps") + 1).alias("level")
    )
