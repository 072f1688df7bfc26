"""Reports over the bank star.

Every report first reduces transactions to one row per account (and type), then joins accounts
and clients, which are unique on their keys. The wide table is shuffled once, already combined
on the map side, and no join ever multiplies balances.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions import predicates as p
from ledgerkit.functions.exprs import date_diff, percent, tier
from ledgerkit.operators import ordered
from ledgerkit.operators.joins import left_many
from ledgerkit.session import settle
from ledgerkit.sources.bank import Bank

DONE, DEPOSIT, WITHDRAWAL, TRANSFER = "F", "A", "N", "R"

# Share of clients at or below, and the label from there on.
CATEGORIES = [(0.95, "Top 5%"), (0.90, "Top 10%"), (0.75, "Top 25%")]
TIERS = [(500_000, "VIP"), (100_000, "Premium"), (10_000, "Standard")]


def when_type(kind: str, value: Column | str = "amount") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("type") == kind, v)


def amount_of(kind: str) -> Column:
    return F.coalesce(F.sum(when_type(kind)), F.lit(0).cast("decimal(28,2)"))


def per_client(bank: Bank, tx: DataFrame, *aggs: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Aggregates per client (and further keys) that can be combined by sum, min or max.

    Each aggregate is given as ``F.sum(...)``/``F.max(...)`` with an alias; names starting with
    ``first_`` combine by min, ``last_`` by max, all others by sum.
    """
    per_account = tx.groupBy("account_id", *keys).agg(*aggs)
    names = [c for c in per_account.columns if c not in ("account_id", *keys)]
    joined = per_account.join(bank.accounts.select("account_id", "client_id"), "account_id")
    combine = lambda n: (
        F.min(n) if n.startswith("first_") else F.max(n) if n.startswith("last_") else F.sum(n)
    )
    return joined.groupBy("client_id", *keys).agg(*[combine(n).alias(n) for n in names])


def balances(bank: Bank) -> DataFrame:
    """Per client: number of accounts, balance, newest account."""
    return bank.accounts.groupBy("client_id").agg(
        F.count(F.lit(1)).alias("accounts"), F.sum("balance").alias("balance"),
        F.max("opened").alias("last_opened"),
    )


def _count(name: str = "tx_count") -> Column:
    return F.count(F.lit(1)).alias(name)


def _total(name: str = "amount") -> Column:
    return F.sum("amount").alias(name)


# Monthly and top-client reports

HEAD_LIMIT = 100_000

def movement_report(bank: Bank, lo, hi) -> DataFrame:
    """Completed movements per client, account and type in a period."""
    done = bank.tx.filter(p.in_range("ts", lo, hi) & (F.col("state") == DONE))
    per_account = done.groupBy("account_id", "type").agg(
        _count(), _total(), F.min("amount").alias("smallest"), F.max("amount").alias("largest"),
    ).withColumnRenamed("type", "tx_type")
    accounts = bank.accounts.select("account_id", "client_id", "type")
    clients = bank.clients.select("client_id", "name", "segment")
    return per_account.join(accounts, "account_id").join(clients, "client_id").select(
        "client_id", "name", "segment", "account_id", F.col("type").alias("account_type"),
        "tx_type", "tx_count", "amount",
        (F.col("amount").cast("double") / F.col("tx_count")).alias("average"),
        "smallest", "largest",
    )


def month_over_month(bank: Bank, year: int, month: int) -> DataFrame:
    """Per client with movements in the month: this month, the month before, the change."""
    first = p.moment(f"{year:04d}-{month:02d}-01")
    before, after = p.add_months(first, -1), p.add_months(first, 1)
    now = F.col("ts") >= p.literal(first)
    tx = bank.tx.filter(p.in_range("ts", before, after) & (F.col("state") == DONE))
    zero = F.lit(0).cast("decimal(18,2)")
    both = per_client(
        bank, tx,
        F.count_if(now).alias("tx_count"),
        F.sum(F.when(now, F.col("amount")).otherwise(zero)).alias("amount"),
        F.sum(F.when(now, zero).otherwise(F.col("amount"))).alias("previous_amount"),
    ).filter("tx_count > 0")
    change = F.col("amount") - F.col("previous_amount")
    pct = F.when(F.col("previous_amount") > 0, percent(change, "previous_amount")).otherwise(100.0)
    trend = F.when(change > 0, "growth").when(change < 0, "decline").otherwise("unchanged")
    named = bank.clients.select("client_id", "name", "segment").join(both, "client_id")
    return named.select("*", change.alias("change"), pct.alias("change_pct"), trend.alias("trend"))


def monthly_report(
    bank: Bank, year: int, month: int, top: int = 100, page: int = 1, size: int = 20,
) -> DataFrame:
    """One page of the top clients of a month with rank, shares, change and category."""
    rows = settle(month_over_month(bank, year, month))
    chosen = _head(rows, top)
    listed = F.least(F.lit(top), rows.agg(F.count(F.lit(1)).alias("n")).scalar())
    first = (page - 1) * size
    shown = chosen.filter((F.col("ranking") > first) & (F.col("ranking") <= first + size))
    return shown.select(
        "ranking", "client_id", "name", "segment", "tx_count", "amount", "previous_amount",
        "change", "change_pct", "trend", "share_pct", "running_share_pct", "category",
        listed.cast("long").alias("total_rows"), F.lit(page).cast("long").alias("page"),
        F.ceil(listed / size).cast("long").alias("total_pages"),
    ).orderBy("ranking")


def _head(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` largest of all (settled) report rows, with ranking, shares, gap and category.

    All of these follow from the head itself, the number and sum of all rows, and the number of
    rows that tie with the head's last; so no window runs over more than ``n`` rows, ``HEAD_LIMIT`` at most.
    """
    if n > HEAD_LIMIT:
        raise ValueError(f"a report of more than {HEAD_LIMIT} rows is a table: use ordered.with_ranks")
    head = settle(rows.orderBy(F.desc("amount"), "client_id").limit(n))
    ends = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("total"))
    last = head.agg(F.min("amount").alias("last")).scalar()
    reached = rows.filter(F.col("amount") >= last).agg(F.count(F.lit(1)).alias("n")).scalar()
    down = Window.orderBy(F.desc("amount"), "client_id")
    ties = Window.orderBy(F.desc("amount")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    count = ends.select("rows").scalar()
    not_below = F.when(F.col("amount") == last, reached).otherwise(F.count(F.lit(1)).over(ties))
    out = head.withColumns({
        "ranking": F.row_number().over(down).cast("long"),
        "dense_ranking": F.dense_rank().over(Window.orderBy(F.desc("amount"))).cast("long"),
        "running_amount": F.sum("amount").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "gap": F.coalesce(F.col("amount") - F.lag("amount").over(down), F.lit(0).cast(rows.schema["amount"].dataType)),
        "standing": F.when(count > 1, (count - not_below) / (count - 1)).otherwise(F.lit(0.0)),
    })
    total = ends.select("total").scalar()
    return out.select(
        "*", percent("amount", total).alias("share_pct"),
        percent("running_amount", total).alias("running_share_pct"),
        tier("standing", CATEGORIES, "Regular").alias("category"),
    )


def top_clients(bank: Bank, n: int, lo, hi) -> DataFrame:
    """The ``n`` largest clients of a period, with the gap to the client ranked before."""
    tx = bank.tx.filter(p.in_range("ts", lo, hi) & (F.col("state") == DONE))
    totals = per_client(bank, tx, _count(), _total())
    rows = settle(bank.clients.select("client_id", "name", "segment").join(totals, "client_id"))
    return _head(rows, n).select(
        "ranking", "dense_ranking", "client_id", "name", "segment", "tx_count", "amount",
        "share_pct", "running_amount", "running_share_pct", "gap", "category",
    ).orderBy("ranking")


def monthly_by_account(bank: Bank, year: int, month: int) -> DataFrame:
    """Deposits, withdrawals and transfers of a month for every account, zeros included."""
    moved = bank.tx.filter(p.in_month("ts", year, month)).groupBy("account_id").agg(
        amount_of(DEPOSIT).alias("deposits"), amount_of(WITHDRAWAL).alias("withdrawals"),
        amount_of(TRANSFER).alias("transfers"), _count(),
    )
    zero = {"deposits": 0, "withdrawals": 0, "transfers": 0, "tx_count": 0}
    return bank.accounts.select("account_id", "client_id", "balance").join(
        moved, "account_id", "left"
    ).fillna(zero)


def closing_report(bank: Bank, lo, hi) -> DataFrame:
    """Per account type: accounts, balances, movements in the period."""
    moved = bank.tx.filter(p.in_range("ts", lo, hi)).groupBy("account_id").agg(
        _count(), amount_of(DEPOSIT).alias("deposits"), amount_of(WITHDRAWAL).alias("withdrawals"),
    )
    rows = bank.accounts.join(moved, "account_id", "left")
    none = F.lit(0).cast("decimal(28,2)")
    return rows.groupBy("type").agg(
        F.count(F.lit(1)).alias("accounts"), F.count_distinct("client_id").alias("clients"),
        F.sum("balance").alias("balance"),
        F.min(F.when(F.col("balance") > 0, F.col("balance"))).alias("smallest_positive"),
        F.count("tx_count").alias("active_accounts"),
        F.coalesce(F.sum("tx_count"), F.lit(0)).alias("tx_count"),
        F.coalesce(F.sum("deposits"), none).alias("deposits"),
        F.coalesce(F.sum("withdrawals"), none).alias("withdrawals"),
    )


def statement(bank: Bank, client_ids: Sequence[int] | None, lo, hi) -> DataFrame:
    """Accounts of the given clients (all when None) with movements and a running amount.

    Accounts without movements in the period stay as one row.
    """
    accounts = bank.accounts.select("account_id", "client_id", "balance")
    if client_ids is not None:
        accounts = accounts.filter(F.col("client_id").isin(list(client_ids)))
    moves = bank.tx.filter(p.in_range("ts", lo, hi))
    if client_ids is not None and "client_id" in moves.columns:  # laid out by client: read there
        moves = moves.filter(F.col("client_id").isin(list(client_ids)))
    elif client_ids is not None:
        moves = moves.join(accounts.select("account_id"), "account_id", "left_semi")
    moves = moves.drop("client_id")
    signed = F.when(F.col("type") == DEPOSIT, F.col("amount")).otherwise(-F.col("amount"))
    running = ordered.with_running(
        moves, ["account_id"], ["ts", "line", "part_id", "supplier_id"], {"running": signed}
    )
    return left_many(accounts, running, "account_id", listed=moves)


def concentration(bank: Bank, lo, hi) -> tuple[DataFrame, DataFrame]:
    """Volume and risk level per segment, and the 20 clients with the most volume."""
    tx = bank.tx.filter(p.in_range("ts", lo, hi))
    moved = per_client(
        bank, tx, amount_of(DEPOSIT).alias("deposits"), amount_of(WITHDRAWAL).alias("withdrawals"),
        _count(), F.max("ts").alias("last_tx"),
    )
    clients = bank.clients.select("client_id", "name", "segment").join(moved, "client_id")
    clients = clients.withColumn("volume", F.col("deposits") + F.col("withdrawals"))
    segments = clients.groupBy("segment").agg(
        F.count(F.lit(1)).alias("clients"), F.sum("deposits").alias("deposits"),
        F.sum("withdrawals").alias("withdrawals"), F.sum("volume").alias("volume"),
        (F.sum("tx_count").cast("double") / F.count(F.lit(1))).alias("average_tx"),
    )
    whole = segments.agg(F.sum("volume").alias("v")).scalar()
    share = percent("volume", whole)
    segments = segments.withColumn("share_pct", share).withColumn(
        "risk", F.when(share > 40, "HIGH").when(share > 20, "MEDIUM").otherwise("LOW")
    )
    return segments, clients.orderBy(F.desc("volume"), "client_id").limit(20)


def month_analysis(bank: Bank, year: int, month: int, n: int = 10):
    """Top accounts, totals by type and grand totals of a month."""
    tx = bank.tx.filter(p.in_month("ts", year, month))
    top = tx.groupBy("account_id").agg(_count(), _total()).orderBy(F.desc("amount"), "account_id")
    by_type = tx.groupBy("type").agg(
        _count(), _total(), (F.sum("amount").cast("double") / F.count(F.lit(1))).alias("average"),
    )
    totals = tx.agg(
        _count(), _total(), F.count_distinct("account_id").alias("accounts"),
        F.max("amount").alias("largest"),
    )
    return top.limit(n), by_type, totals


def last_activity(bank: Bank) -> DataFrame:
    """Every client with the time of the last movement (null for none)."""
    last = per_client(bank, bank.tx, F.max("ts").alias("last_tx"))
    return bank.clients.join(last, "client_id", "left")


def inactive_clients(bank: Bank, days: int, as_of, segments: Sequence[str] | None = None):
    """Clients without a movement for ``days`` days, per segment, and the dormant total."""
    idle = date_diff("day", "last_tx", p.literal(as_of).cast("timestamp_ntz"))
    rows = last_activity(bank).withColumn("days_idle", idle)
    rows = rows.filter((F.col("days_idle") >= days) | F.col("last_tx").isNull())
    if segments:
        rows = rows.filter(F.col("segment").isin(list(segments)))
    rows = rows.join(balances(bank).select("client_id", "balance"), "client_id", "left").withColumn(
        "balance", F.coalesce("balance", F.lit(0).cast("decimal(28,2)"))
    )
    listed = rows.select("client_id", "name", "segment", "last_tx", "days_idle", "balance")
    totals = [F.count(F.lit(1)).alias("clients"), F.sum("balance").alias("dormant")]
    return listed, listed.groupBy("segment").agg(*totals), listed.agg(*totals)


def client_report(bank: Bank, as_of, segment: str | None = None) -> DataFrame:
    """Client 360: accounts, balance, transactions, last activity, level of activity."""
    clients = bank.clients if segment is None else bank.clients.filter(F.col("segment") == segment)
    moved = per_client(bank, bank.tx, _count(), F.max("ts").alias("last_tx"))
    out = clients.join(balances(bank), "client_id", "left").join(moved, "client_id", "left")
    recent = p.literal(p.add_months(as_of, -1))
    some = p.literal(p.add_months(as_of, -3))
    level = F.when(F.col("last_tx") >= recent, "active").when(
        F.col("last_tx") >= some, "moderate"
    ).otherwise("inactive")
    return out.select(
        "client_id", "name", "segment", F.coalesce("accounts", F.lit(0)).alias("accounts"),
        F.coalesce("balance", F.lit(0).cast("decimal(28,2)")).alias("balance"),
        F.coalesce("tx_count", F.lit(0)).alias("tx_count"), "last_tx",
        date_diff("day", "last_tx", p.literal(as_of).cast("timestamp_ntz")).alias("days_idle"),
        level.alias("activity"),
    )


def client_summary(bank: Bank) -> DataFrame:
    """One row per client with the tier of its balance."""
    moved = per_client(bank, bank.tx, _count(), F.max("ts").alias("last_tx"))
    out = bank.clients.join(balances(bank), "client_id", "left").join(moved, "client_id", "left")
    return out.select(
        "client_id", "name", "segment", "accounts", "balance", "tx_count", "last_tx",
        tier("balance", TIERS, "Basic").alias("tier"),
    )


def segment_summary(summary: DataFrame) -> DataFrame:
    return summary.groupBy("segment", "tier").agg(
        F.count(F.lit(1)).alias("clients"), F.sum("balance").alias("balance"),
        (F.sum("accounts").cast("double") / F.count(F.lit(1))).alias("average_accounts"),
    )


def consolidated(bank: Bank) -> DataFrame:
    """Source rows for the consolidated-balance table (see ``merge.upsert``)."""
    return bank.clients.select("client_id").join(balances(bank), "client_id", "left").select(
        "client_id", F.coalesce("balance", F.lit(0).cast("decimal(28,2)")).alias("balance"),
        F.coalesce("accounts", F.lit(0)).alias("accounts"), "last_opened",
    )


def balance(bank: Bank, account_id: int) -> DataFrame:
    return bank.accounts.filter(F.col("account_id") == account_id).select(
        "account_id", "balance", "state"
    )


def day_summary(bank: Bank, lo, hi) -> DataFrame:
    """Per day and type: count and amounts, split by outcome."""
    return bank.tx.filter(p.in_range("ts", lo, hi)).groupBy(
        F.to_date("ts").alias("day"), "type"
    ).agg(
        _count(), _total(), F.count_if(F.col("state") == DONE).alias("completed"),
        F.sum(F.when(F.col("state") != DONE, F.col("amount"))).alias("open_amount"),
    )


def day_detail(bank: Bank, lo, hi) -> DataFrame:
    """Transactions of the days with their account; unknown accounts keep the row."""
    account = bank.accounts.select(
        "account_id", "client_id", F.col("state").alias("account_state"), "opened"
    )
    return bank.tx.filter(p.in_range("ts", lo, hi)).join(account, "account_id", "left")


def dashboard(bank: Bank, as_of) -> DataFrame:
    """Metrics of different kinds as name and value rows, one pass per table."""
    recent = p.last("ts", 30, "day", as_of)
    number = lambda c: c.cast("double")
    tx = bank.tx.filter(F.col("ts") <= p.literal(as_of)).agg(
        number(F.count_if(recent)).alias("tx_last_30_days"),
        number(F.sum(F.when(recent, F.col("amount")))).alias("amount_last_30_days"),
        number(F.count_if(F.col("state") != DONE)).alias("open_transactions"),
    )
    accounts = bank.accounts.agg(
        number(F.count_if(F.col("state") == "O")).alias("open_accounts"),
        number(F.sum("balance")).alias("total_balance"),
    )
    clients = bank.clients.agg(number(F.count(F.lit(1))).alias("clients"))
    out = None
    for row in (tx, accounts, clients):
        part = row.unpivot([], row.columns, "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out


def year_month(bank: Bank) -> DataFrame:
    return bank.tx.groupBy(F.year("ts").alias("year"), F.month("ts").alias("month"), "type").agg(
        _count(), _total()
    )


def heavy_months(bank: Bank, min_count: int, min_amount: float) -> DataFrame:
    """Year, month and client with enough transactions and volume."""
    monthly = per_client(
        bank, bank.tx.withColumns({"year": F.year("ts"), "month": F.month("ts")}),
        _count(), _total(), keys=["year", "month"],
    )
    return monthly.filter((F.col("tx_count") >= min_count) & (F.col("amount") > min_amount))


def frequent_large(bank: Bank, amount: float, n: int) -> DataFrame:
    """Clients with more than ``n`` transactions over an amount."""
    large = bank.tx.filter(F.col("amount") > amount)
    counted = per_client(bank, large, _count(), _total()).filter(F.col("tx_count") > n)
    return bank.clients.select("client_id", "name", "segment").join(counted, "client_id")


def clients_over(bank: Bank, bound: float) -> DataFrame:
    rich = balances(bank).filter(F.col("balance") > bound)
    return bank.clients.select("client_id", "name", "segment").join(rich, "client_id")


def annual_report(bank: Bank, year: int) -> DataFrame:
    """Year total per client; clients without movements show zero."""
    moved = per_client(bank, bank.tx.filter(p.in_year("ts", year)), _count(), _total())
    return bank.clients.select("client_id", "name").join(moved, "client_id", "left").fillna(
        0, ["tx_count", "amount"]
    )


def find_transactions(
    bank: Bank, lo=None, hi=None, account_id=None, kind=None, min_amount=None, max_amount=None,
) -> DataFrame:
    """Search with any combination of filters; ``hi`` is the last day, included."""
    given = p.when_given
    return p.optional_filters(
        bank.tx,
        given(lo, lambda v: F.col("ts") >= p.literal(v)),
        given(hi, lambda v: F.col("ts") < p.literal(p.shift(v, 1, "day"))),
        given(account_id, lambda v: F.col("account_id") == v),
        given(kind, lambda v: F.col("type") == v),
        given(min_amount, lambda v: F.col("amount") >= v),
        given(max_amount, lambda v: F.col("amount") <= v),
    )


def alert_queue(alerts: DataFrame, as_of, severity: int = 3, n: int = 100):
    """Worklist (open alerts of high severity, newest first), counts, fraud alerts of the last month.

    The counts are per analyst, type and state.
    """
    open_ = alerts.filter((F.col("state") == "OPEN") & (F.col("severity") >= severity))
    per_analyst = alerts.groupBy("analyst", "type", "state").agg(F.count(F.lit(1)).alias("alerts"))
    fraud = alerts.filter((F.col("type") == "FRAUD") & p.last("ts", 1, "month", as_of))
    queue = open_.orderBy(F.desc("ts"), F.desc("severity"), "alert_id").limit(n)
    return queue, per_analyst, fraud


def client_reports(
    df: DataFrame, report: Column, rules: Sequence[tuple[Column, str]] = (), key: str = "client_id",
) -> DataFrame:
    """A text per row; a row that breaks one of ``rules`` (condition, error) gets its error instead."""
    error = F.lit(None).cast("string")
    for broken, text in reversed(rules):
        error = F.when(broken, text).otherwise(error)
    return df.select(key, F.when(error.isNull(), report).alias("report"), error.alias("error"))


def accounts_with_counts(bank: Bank, kind: str | None = None) -> DataFrame:
    """Accounts, of one type or of all, with their client and number of transactions (0 for none)."""
    accounts = bank.accounts if kind is None else bank.accounts.filter(F.col("type") == kind)
    counts = bank.tx.groupBy("account_id").agg(_count())
    named = accounts.join(bank.clients.select("client_id", "name", "segment"), "client_id", "left")
    return named.join(counts, "account_id", "left").select(
        "account_id", "type", "state", "balance", "client_id", "name", "segment",
        F.coalesce("tx_count", F.lit(0)).cast("long").alias("tx_count"))


def report_counts(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count("report").alias("succeeded"), F.count("error").alias("failed")
    )
