"""Searches with optional parameters. Values are bound, names are checked against the schema."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.functions import predicates as p
from ledgerkit.operators import ordered
from ledgerkit.operators.paging import page as cut_page
from ledgerkit.plans.reports import balances
from ledgerkit.sources.bank import Bank

Registry = Mapping[str, DataFrame]


class UnknownName(ValueError):
    """A table or column that does not exist."""


def run_sql(spark: SparkSession, sql: str, **values) -> DataFrame:
    """Run a statement with bound values (``:name``); text in a value stays text."""
    return spark.sql(sql, args=values)


def out_value(df: DataFrame):
    """An output parameter: first column of the only row."""
    row = df.first()
    return row[0] if row else None


def table_function(spark: SparkSession, name: str, parameters: str, query: str) -> None:
    """A table with parameters, for use in SQL of this session: ``SELECT * FROM name(1, 'x')``.

    The definition is written by the developer; values go in as arguments of the call.
    """
    if not name.isidentifier():
        raise UnknownName(f"function {name!r}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE RETURN {query}")


def table(registry: Registry, name: str) -> DataFrame:
    if name not in registry:
        raise UnknownName(f"table {name!r}")
    return registry[name]


def ident(df: DataFrame, name: str) -> Column:
    """A column that must exist, quoted."""
    if name not in df.columns:
        raise UnknownName(f"column {name!r}")
    return df["`" + name.replace("`", "``") + "`"]


def search(
    registry: Registry, name: str, column: str | None = None, value=None,
    order: str | None = None, ascending: bool = True, top: int = 100,
) -> DataFrame:
    """Rows of any registered table; an unknown sort column is ignored."""
    df = table(registry, name)
    if column is not None:
        ident(df, column)
        df = df.filter(p.eq_typed(df, column, value))
    if order in df.columns:
        df = df.orderBy(ident(df, order).asc() if ascending else ident(df, order).desc())
    return df.limit(top)


def search_field(df: DataFrame, fields: Mapping[str, str], field: str, text: str) -> DataFrame:
    """LIKE on a field of a whitelist (public name -> column). Wildcards in the text are text."""
    if field not in fields:
        raise UnknownName(f"field {field!r}")
    return df.filter(F.contains(ident(df, fields[field]), F.lit(text)))


def list_ordered(df: DataFrame, orders: Mapping[str, str], order: str, default: str) -> DataFrame:
    """Sort by a whitelisted order; anything else means the default."""
    return df.orderBy(*ordered.sort_columns([orders.get(order, default)]))


def _client_filters(name, segment, branch_id, min_credit, max_credit) -> list[Column | None]:
    given = p.when_given
    return [
        given(name, lambda v: F.contains(F.col("name"), F.lit(v))),
        given(segment, lambda v: F.col("segment") == v),
        given(branch_id, lambda v: F.col("branch_id") == v),
        given(min_credit, lambda v: F.col("credit") >= v),
        given(max_credit, lambda v: F.col("credit") <= v),
    ]


def search_clients(
    bank: Bank, name=None, segment=None, branch_id=None, min_credit=None, max_credit=None,
    min_balance=None, max_balance=None, order: str = "client_id",
) -> DataFrame:
    """Clients by any of seven filters, with the sum of their balances and number of accounts."""
    clients = p.optional_filters(
        bank.clients, *_client_filters(name, segment, branch_id, min_credit, max_credit))
    out = clients.join(balances(bank).drop("last_opened"), "client_id", "left").fillna(
        0, ["accounts", "balance"])
    given = p.when_given
    out = p.optional_filters(
        out,
        given(min_balance, lambda v: F.col("balance") >= v),
        given(max_balance, lambda v: F.col("balance") <= v),
    )
    orders = {c: c for c in out.columns} | {"-" + c: "-" + c for c in out.columns}
    return list_ordered(out, orders, order, "client_id")


def search_accounts(
    bank: Bank, kind=None, state=None, min_balance=None, max_balance=None, opened_from=None,
    opened_to=None, client_id=None,
) -> DataFrame:
    given = p.when_given
    return p.optional_filters(
        bank.accounts,
        given(kind, lambda v: F.col("type") == v),
        given(state, lambda v: F.col("state") == v),
        given(min_balance, lambda v: F.col("balance") >= v),
        given(max_balance, lambda v: F.col("balance") <= v),
        given(opened_from, lambda v: F.col("opened") >= p.literal(v)),
        given(opened_to, lambda v: F.col("opened") < p.literal(p.shift(v, 1, "day"))),
        given(client_id, lambda v: F.col("client_id") == v),
    )


def search_transactions(
    bank: Bank, types: str | None = None, lo=None, hi=None, min_amount=None, max_amount=None,
    state=None, client_id=None,
) -> DataFrame:
    """``types`` is a comma list; ``hi`` is the last day, included."""
    given = p.when_given
    kinds = None if types is None else [t.strip() for t in types.split(",") if t.strip()]
    rows = p.optional_filters(
        bank.tx,
        given(kinds, lambda v: p.any_of(bank.tx, "type", v)),
        given(lo, lambda v: F.col("ts") >= p.literal(v)),
        given(hi, lambda v: F.col("ts") < p.literal(p.shift(v, 1, "day"))),
        given(min_amount, lambda v: F.col("amount") >= v),
        given(max_amount, lambda v: F.col("amount") <= v),
        given(state, lambda v: F.col("state") == v),
    )
    if client_id is None:
        return rows
    own = bank.accounts.filter(F.col("client_id") == client_id).select("account_id")
    return rows.join(own, "account_id", "left_semi")


def search_page(
    bank: Bank, page: int = 1, size: int = 20, order: str = "balance", debug: bool = False,
    min_balance=None, **filters,
) -> DataFrame | str:
    """Client search with balance filter, whitelisted order, page and counts; or its plan."""
    orders = {
        "balance": ["-balance", "client_id"], "client": ["client_id"],
        "accounts": ["-accounts", "client_id"],
    }
    names = ["name", "segment", "branch_id", "min_credit", "max_credit"]
    clients = p.optional_filters(bank.clients, *_client_filters(*[filters.get(n) for n in names]))
    out = clients.join(balances(bank).drop("last_opened"), "client_id")
    if min_balance is not None:
        out = out.filter(F.col("balance") >= min_balance)
    out = cut_page(out, orders.get(order, ["client_id"]), page, size)
    if not debug:
        return out
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("formatted")
    return text.getvalue()


def count_where(registry: Registry, name: str, column: str | None = None, value=None) -> DataFrame:
    df = table(registry, name)
    if column is not None:
        ident(df, column)
        df = df.filter(p.eq_typed(df, column, value))
    return df.agg(F.count(F.lit(1)).alias("rows"))


def client_accounts(
    bank: Bank, show_balance: bool = True, show_count: bool = True, show_last: bool = False,
    segment=None,
) -> DataFrame:
    """Report with switchable columns; columns not asked for are not computed."""
    chosen = [
        n for n, on in [("accounts", show_count), ("balance", show_balance), ("last_opened", show_last)]
        if on
    ]
    clients = bank.clients.select("client_id", "name", "segment")
    if segment is not None:
        clients = clients.filter(F.col("segment") == segment)
    if not chosen:
        return clients
    return clients.join(balances(bank).select("client_id", *chosen), "client_id", "left")
