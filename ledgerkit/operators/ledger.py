"""Posting of request batches to accounts: validation, acceptance in order, balances, close of day."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerkit.functions import predicates as p
from ledgerkit.functions.exprs import percent
from ledgerkit.operators import ordered
from ledgerkit.operators.merge import update_where
from ledgerkit.session import discard, settle, settled

MONEY = "decimal(18,2)"

# Limits, and the codes of the transfer rules in the order they are checked.
TRANSFER_LIMIT = 1_000_000
DAILY_LIMIT = 10_000
CASH_LIMIT = 50_000
CODES = {
    50001: "amount is not positive", 50002: "amount over the limit", 50003: "same account",
    50004: "unknown source", 50005: "source not active", 50006: "source is a term deposit",
    50007: "not enough funds", 50008: "unknown destination", 50009: "destination not active",
}


def _case(rules: Sequence[tuple[Column, int | str]], other=None) -> Column:
    out = F.lit(other)
    for cond, label in reversed(rules):
        out = F.when(cond, label).otherwise(out)
    return out


def _transfer_rules(req: DataFrame, accounts: DataFrame, active: str, term: str) -> DataFrame:
    """Requests with the first failing rule before (``__first``) and after (``__last``) that of funds."""
    side = lambda name: accounts.select(
        F.col("account_id").alias(name), F.col("state").alias(f"__{name}_state"),
        F.col("type").alias(f"__{name}_type"), F.col("balance").alias(f"__{name}_balance"))
    rows = req.join(side("source"), "source", "left").join(side("dest"), "dest", "left")
    first = _case([
        (F.col("amount") <= 0, 50001), (F.col("amount") > TRANSFER_LIMIT, 50002),
        (F.col("source") == F.col("dest"), 50003), (F.col("__source_state").isNull(), 50004),
        (F.col("__source_state") != active, 50005), (F.col("__source_type") == term, 50006),
    ])
    last = _case([(F.col("__dest_state").isNull(), 50008), (F.col("__dest_state") != active, 50009)])
    return rows.select(
        *req.columns, F.col("__source_balance").alias("__funds"), first.cast("int").alias("__first"),
        last.cast("int").alias("__last"))


def validate_transfers(
    req: DataFrame, accounts: DataFrame, active: str = "ACTIVE", term: str = "TERM",
) -> DataFrame:
    """Requests (source, dest, amount), each by itself, with the first failing rule of CODES.

    The code is null when the request is good. Funds are those of the opening balance; for
    requests that follow one another see ``post_transfers``.
    """
    rows = _transfer_rules(req, accounts, active, term)
    short = F.when(F.col("__funds") < F.col("amount"), 50007)
    return rows.select(*req.columns, F.coalesce("__first", short, "__last").alias("code"))


def post_transfers(
    req: DataFrame, accounts: DataFrame, order: Sequence[str], active: str = "ACTIVE", term: str = "TERM",
    group_rows: int = 1_000_000,
) -> DataFrame:
    """Transfers in ``order``: each sees the balance its source has left; adds ``code`` (null: accepted).

    What a batch brings to an account cannot be spent in the same batch, so sources are
    independent of each other and no balance ends below zero. ``order`` is unique per source.
    """
    names = req.columns
    rows = settle(_transfer_rules(req, accounts, active, term).withColumns({
        "cents": (F.col("amount") * 100).cast("long"), "room": (F.col("__funds") * 100).cast("long")}))
    failed = rows.filter("__first IS NOT NULL").select(*names, F.col("__first").alias("code"))
    good = rows.filter("__first IS NULL AND __last IS NULL")
    decided = settle(accept_in_order(good, ["source"], order, group_rows))
    code = F.when(~F.col("accepted"), 50007).cast("int").alias("code")
    # A request without a good destination takes nothing, but funds are checked before that.
    lost = rows.filter("__first IS NULL AND __last IS NOT NULL")
    spent = F.when(F.col("accepted"), F.col("cents")).otherwise(F.lit(0))
    both = decided.withColumn("__spent", spent).unionByName(
        lost.withColumns({"accepted": F.lit(None).cast("boolean"), "__spent": F.lit(0).cast("long")}))
    # Only sources with such requests need the running sum.
    both = both.join(lost.select("source").distinct(), "source", "left_semi")
    sums = ordered.with_running(both, ["source"], order, {"__used": F.col("__spent")}, group_rows)
    sums = sums.filter("__last IS NOT NULL")
    short = F.when(F.col("room") - F.col("__used") < F.col("cents"), 50007)
    return failed.unionByName(decided.select(*names, code)).unionByName(
        sums.select(*names, F.coalesce(short, "__last").alias("code")))


def validate_deposits(
    req: DataFrame, accounts: DataFrame, origins: Sequence[str], cash: str = "CASH",
    active: str = "ACTIVE",
) -> DataFrame:
    """Deposits (account_id, amount, origin) with the first failing rule, or OK."""
    states = accounts.select("account_id", F.col("state").alias("__state"))
    rows = req.join(states, "account_id", "left")
    status = _case([
        (F.col("amount") <= 0, "AMOUNT"), (~F.coalesce(F.col("origin").isin(list(origins)), F.lit(False)), "ORIGIN"),
        ((F.col("origin") == cash) & (F.col("amount") > CASH_LIMIT), "NEEDS_APPROVAL"),
        (F.col("__state").isNull(), "UNKNOWN_ACCOUNT"), (F.col("__state") != active, "NOT_ACTIVE"),
    ], "OK")
    return rows.select(*req.columns, status.alias("status"))


# Acceptance in order

def _accept_run(cents: np.ndarray, left: int) -> tuple[np.ndarray, int]:
    """Accept what fits, one after the other; whole runs at once from the running sum."""
    taken = np.zeros(len(cents), dtype=bool)
    sums = np.cumsum(cents)
    at = 0
    while at < len(cents) and left > 0:
        before = int(sums[at] - cents[at])
        end = int(np.searchsorted(sums, left + before, "right"))
        if end > at:
            taken[at:end] = True
            left -= int(sums[end - 1]) - before
        at = max(end, at) + 1  # the row at ``end`` does not fit
    return taken, left


def _accept_in_stream(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Walk the sorted rows of each partition once, carrying what is left of the current group."""
    names = rows.columns

    def walk(batches):
        current, left = None, 0
        for batch in batches:
            if batch.empty:
                continue
            cents, room = batch["cents"].to_numpy(), batch["room"].to_numpy()
            first = np.zeros(len(batch), dtype=bool)
            for g in group:
                values = batch[g].to_numpy()
                first[1:] |= values[1:] != values[:-1]
            first[0] = tuple(batch[g].iloc[0] for g in group) != current
            taken = np.zeros(len(batch), dtype=bool)
            starts = np.flatnonzero(first).tolist()
            for start, end in zip([0, *starts], [*starts, len(batch)]):
                if end > start:
                    left = int(room[start]) if first[start] else left
                    taken[start:end], left = _accept_run(cents[start:end], left)
            current = tuple(batch[g].iloc[-1] for g in group)
            yield batch.assign(accepted=taken)[[*names, "accepted"]]

    arranged = rows.repartition(*group).sortWithinPartitions(*group, *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return arranged.mapInPandas(walk, kinds + ", accepted boolean")


def accept_in_order(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], group_rows: int = 1_000_000,
) -> DataFrame:
    """Accept each row whose ``cents`` still fit into the ``room`` of its group; adds ``accepted``.

    ``rows`` carries positive ``cents`` and the group's ``room``. Whether a row fits depends on
    the rows accepted before it, so this is no window function:

    - rows above the room can never fit, and groups whose sum fits are accepted whole,
    - other groups of up to ``group_rows`` rows are walked in order, many groups per task,
    - of a larger group, sliced running sums accept everything before its first refusal. What follows is cut
      into slices of ``group_rows`` rows in its order. Round i walks slice i of all large groups
      and carries what each has left, so the number of rounds is known beforehand: the most
      rows after a first refusal by ``group_rows``.
    """
    rows = settled(rows)
    keys = list(group)
    fits = F.col("cents") <= F.col("room")
    out = rows.filter(~fits).withColumn("accepted", F.lit(False))
    open_ = rows.filter(fits)
    named = [F.col(k).alias("__k_" + k) for k in keys]
    sums = settle(open_.groupBy(*named).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("cents").alias("__sum"), F.max("room").alias("__room")))
    on = [F.col(k).eqNullSafe(F.col("__k_" + k)) for k in keys]
    kind = F.when(F.col("__sum") <= F.col("__room"), 0).when(F.col("__n") <= group_rows, 1).otherwise(2)
    marks = sums.select(*["__k_" + k for k in keys], kind.alias("__kind"))
    marked = open_.join(marks, on).select(*rows.columns, "__kind")
    plain = lambda df: df.select(*rows.columns)
    out = out.unionByName(plain(marked.filter("__kind = 0")).withColumn("accepted", F.lit(True)))
    out = out.unionByName(_accept_in_stream(plain(marked.filter("__kind = 1")), group, order))
    if sums.filter(kind == 2).isEmpty():
        return out
    running = settle(ordered.with_running(
        plain(marked.filter("__kind = 2")), group, order,
        {"__rn": F.lit(1).cast("long"), "__cum": F.col("cents")}, group_rows))
    refused = running.filter("__cum > room").groupBy(*named).agg(
        F.min("__rn").alias("__cut"), F.min_by(F.col("room") - F.col("__cum") + F.col("cents"), "__rn").alias("__left"))
    split = settle(running.join(refused, on))  # every large group has a refusal, as its sum does not fit
    out = out.unionByName(plain(split.filter("__rn < __cut")).withColumn("accepted", F.lit(True)))
    kind_of_room = rows.schema["room"].dataType
    rest = split.filter("__rn >= __cut").withColumns({
        "room": F.col("__left").cast(kind_of_room), "__slice_no": F.floor((F.col("__rn") - F.col("__cut")) / group_rows)})
    sliced = settle(rest.select(*rows.columns, "__slice_no"))
    left, walked = None, None
    for number in range((sliced.agg(F.max("__slice_no")).first()[0] or 0) + 1):
        part = sliced.filter(F.col("__slice_no") == number).drop("__slice_no")
        if left is not None:
            part = plain(part.join(left, on, "left").withColumn("room", F.coalesce("__left", "room").cast(kind_of_room)))
        done = settle(_accept_in_stream(part, group, order))
        before, left = left, settle(done.groupBy(*named).agg(
            (F.max("room") - F.coalesce(F.sum(F.when(F.col("accepted"), F.col("cents"))), F.lit(0))).alias("__left")))
        discard(before)
        walked = done if walked is None else walked.unionByName(done)
        if number % 10 == 9:  # keeps the plan short
            walked = settle(walked)
    return out.unionByName(walked)


def _post_in_stream(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Walk the sorted requests of each account once, under the day's limit and the balance together."""
    names = rows.columns

    def walk(batches):
        current, left, today = None, 0, 0
        for batch in batches:
            if batch.empty:
                continue
            account, day = batch["account_id"].to_numpy(), batch["day"].to_numpy()
            cents, limit, funds = (batch[c].to_numpy() for c in ("cents", "room", "__funds"))
            new_account, new_day = np.ones(len(batch), dtype=bool), np.ones(len(batch), dtype=bool)
            new_account[1:] = account[1:] != account[:-1]
            new_day[1:] = new_account[1:] | (day[1:] != day[:-1])
            if current is not None:
                new_account[0] = current[0] != account[0]
                new_day[0] = new_account[0] or current[1] != day[0]
            taken = np.zeros(len(batch), dtype=bool)
            starts = np.flatnonzero(new_day).tolist()
            for start, end in zip([0, *starts], [*starts, len(batch)]):
                if end == start:
                    continue
                if new_account[start]:
                    left = int(funds[start])
                if new_day[start]:
                    today = int(limit[start])
                # Both shrink by what is accepted, so the smaller one decides the whole run.
                room = min(today, left)
                taken[start:end], rest = _accept_run(cents[start:end], room)
                left, today = left - room + rest, today - room + rest
            current = (account[-1], day[-1])
            yield batch.assign(accepted=taken)[[*names, "accepted"]]

    arranged = rows.repartition("account_id").sortWithinPartitions("account_id", "day", *order)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return arranged.mapInPandas(walk, kinds + ", accepted boolean")


def post_withdrawals(
    req: DataFrame, accounts: DataFrame, order: Sequence[str], daily_limit: float = DAILY_LIMIT,
    active: str = "ACTIVE", group_rows: int = 1_000_000,
) -> DataFrame:
    """Withdrawals (account_id, day, amount) accepted one after the other within each account.

    A row is accepted when it fits the balance and the day's limit, both after the rows accepted
    before it. Accounts whose days and sum all fit are accepted by their sums; the others are walked once, limit and
    balance together. Accounts above ``group_rows`` rows are posted by slices (``_post_large``).
    """
    known = accounts.select(
        "account_id", F.col("state").alias("__state"), F.col("balance").alias("__balance"))
    rows = req.join(known, "account_id", "left").withColumns({
        "cents": (F.col("amount") * 100).cast("long"),
        "room": F.lit(round(daily_limit * 100)).cast("long"),
        "__funds": (F.col("__balance") * 100).cast("long"),
    })
    status = _case([
        (F.col("amount") <= 0, "AMOUNT"), (F.col("__state").isNull(), "UNKNOWN_ACCOUNT"),
        (F.col("__state") != active, "NOT_ACTIVE"),
    ])
    rows = rows.withColumn("status", status)
    keep = list(dict.fromkeys(["account_id", "day", *order]))
    result = [*keep, "amount", "status"]
    money = (F.col("cents") / 100).cast(MONEY).alias("amount")
    label = F.when(F.col("accepted"), "ACCEPTED").otherwise("LIMIT").alias("status")
    invalid = rows.filter("status IS NOT NULL").select(*result)
    valid = rows.filter("status IS NULL").select(*keep, "cents", "room", "__funds")
    valid = settle(valid)
    days = valid.groupBy("account_id", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("sum"), F.max("room").alias("room"), F.max("__funds").alias("funds"))
    whole = F.max(F.col("sum") - F.col("room")).alias("over"), F.sum("sum").alias("sum")
    per = days.groupBy("account_id").agg(F.sum("n").alias("n"), F.max("funds").alias("funds"), *whole)
    fits = (F.col("over") <= 0) & (F.col("sum") <= F.col("funds"))
    kind = F.when(fits, 0).when(F.col("n") <= group_rows, 1).otherwise(2)
    marks = settle(per.select("account_id", kind.alias("__kind")))
    marked = valid.join(marks, "account_id")
    good = marked.filter("__kind = 0").select(*keep, "cents", F.lit(True).alias("accepted"))
    good = good.unionByName(_post_in_stream(
        marked.filter("__kind = 1").drop("__kind"), order).select(*keep, "cents", "accepted"))
    if not marks.filter("__kind = 2").isEmpty():
        large = settle(marked.filter("__kind = 2").drop("__kind"))
        good = good.unionByName(_post_large(large, order, keep, group_rows))
    return good.select(*keep, money, label).unionByName(invalid)


def _post_large(rows: DataFrame, order: Sequence[str], keep: Sequence[str], group_rows: int) -> DataFrame:
    """Accounts too large for one task.

    Days are first settled by the limit alone, all in parallel. As long as the balance
    covers what the days take, that is the result. From the first day it does not, what is left
    is below the daily limit, so only the balance counts from there on.
    """
    by_day = settle(accept_in_order(rows, ["account_id", "day"], order, group_rows))
    taken = by_day.groupBy("account_id", "day").agg(
        F.sum(F.when(F.col("accepted"), F.col("cents")).otherwise(0)).alias("taken"),
        F.max("__funds").alias("__funds"),
    )
    # One row per account and day: the calendar bounds the window.
    earlier = Window.partitionBy("account_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__funds") - F.coalesce(F.sum("taken").over(earlier), F.lit(0))
    short = taken.withColumn("left", before).filter(F.col("left") < F.col("taken"))
    turn = settle(short.groupBy("account_id").agg(
        F.min("day").alias("__from"), F.min_by("left", "day").alias("__left")))
    split = by_day.join(turn, "account_id", "left")
    fine = split.filter(F.col("__from").isNull() | (F.col("day") < F.col("__from")))
    tight = split.filter(F.col("day") >= F.col("__from")).withColumn("room", F.col("__left"))
    tight = accept_in_order(tight.select(*keep, "cents", "room"), ["account_id"], ["day", *order], group_rows)
    return fine.select(*keep, "cents", "accepted").unionByName(tight.select(*keep, "cents", "accepted"))


# Balances

def legs(movements: DataFrame) -> DataFrame:
    """Debit and credit of each movement; their sum is zero."""
    out = movements.select(F.col("source").alias("account_id"), (-F.col("amount")).alias("change"))
    return out.unionByName(movements.select(F.col("dest").alias("account_id"), F.col("amount").alias("change")))


def apply_postings(accounts: DataFrame, movements: DataFrame) -> DataFrame:
    """Balances after all movements, netted per account before the join."""
    net = legs(movements).groupBy("account_id").agg(F.sum("change").alias("__net"))
    joined = accounts.join(net, "account_id", "left")
    new = F.col("balance") + F.coalesce("__net", F.lit(0).cast("decimal(28,2)"))
    return joined.withColumn("balance", new.cast(MONEY)).drop("__net")


def spread_amount(accounts: DataFrame, source: int, total, active: str = "ACTIVE") -> DataFrame:
    """Take ``total`` from one account and spread it evenly over all other active ones.

    Cents that do not divide evenly go to the first accounts by id, so all changes sum to zero.
    """
    others = accounts.filter((F.col("state") == active) & (F.col("account_id") != source))
    count = others.agg(F.count(F.lit(1)).alias("n")).scalar()
    cents = F.lit(round(float(total) * 100)).cast("long")
    numbered = ordered.number_rows(others.select("account_id"), [], ["account_id"], "__rn")
    share = F.floor(cents / count) + F.when(F.col("__rn") <= cents % count, 1).otherwise(0)
    part = numbered.select("account_id", (share / 100).cast(MONEY).alias("__part"))
    given = F.when(count > 0, (cents / 100).cast(MONEY)).otherwise(F.lit(0).cast(MONEY))
    joined = accounts.join(part, "account_id", "left")
    change = F.when(F.col("account_id") == source, -given).otherwise(
        F.coalesce("__part", F.lit(0).cast(MONEY)))
    return joined.withColumn("balance", (F.col("balance") + change).cast(MONEY)).drop("__part")


def accrue_interest(accounts: DataFrame, rates: Mapping[str, str], periods: int = 365) -> DataFrame:
    """Interest of one period by account type; types without a rate earn nothing."""
    rate = F.lit("0").cast("decimal(9,6)")
    for kind, value in rates.items():
        rate = F.when(F.col("type") == kind, F.lit(value).cast("decimal(9,6)")).otherwise(rate)
    interest = F.round(F.col("balance") * rate / F.lit(periods), 2).cast(MONEY)
    out = accounts.withColumn("interest", F.when(F.col("balance") > 0, interest).otherwise(F.lit(0).cast(MONEY)))
    return out.withColumn("new_balance", (F.col("balance") + F.col("interest")).cast(MONEY))


def commissions(
    tx: DataFrame, lo, hi, transfer: str, withdrawal: str, service: str, done: str,
) -> DataFrame:
    """Commission of each completed transaction of a period.

    Transfers 1 %, services 0.5 %, withdrawals 25, or 50 when over 10,000.
    """
    amount, kind = F.col("amount"), F.col("type")
    fee = F.when(kind == transfer, amount * F.lit("0.01").cast("decimal(5,4)")).when(
        kind == withdrawal, F.when(amount > 10_000, 50).otherwise(25).cast("decimal(18,4)")
    ).when(kind == service, amount * F.lit("0.005").cast("decimal(5,4)"))
    rows = tx.filter(
        p.in_range("ts", lo, hi) & (F.col("state") == done) & kind.isin(transfer, withdrawal, service))
    return rows.withColumn("commission", fee.cast("decimal(18,4)"))


def block_negative(accounts: DataFrame, as_of, days: int = 30, blocked: str = "BLOCKED") -> DataFrame:
    """Block accounts that are negative and had no movement for more than ``days`` days."""
    stale = (F.col("balance") < 0) & p.older_than("last_move", days, "day", as_of)
    return update_where(accounts, stale, {"state": F.lit(blocked)})


def low_balance_alerts(accounts: DataFrame, bound: float) -> DataFrame:
    low = accounts.filter(F.col("balance") < bound)
    return low.select(
        "account_id", "client_id", "balance",
        F.when(F.col("balance") < 0, "OVERDRAWN").otherwise("LOW").alias("alert"))


def close_day(tx: DataFrame, day, pending: str, done: str) -> tuple[DataFrame, DataFrame]:
    """Pending transactions of the day become processed; summary per type with shares."""
    today = p.on_day("ts", day)
    closed = update_where(tx, today & (F.col("state") == pending), {"state": F.lit(done)})
    rows = closed.filter(today & (F.col("state") == done))
    sums = rows.groupBy("type").agg(F.count(F.lit(1)).alias("tx_count"), F.sum("amount").alias("amount"))
    whole = sums.agg(F.sum("amount").alias("a"), F.sum("tx_count").alias("n"))
    summary = sums.select(
        "type", "tx_count", "amount",
        (F.col("amount").cast("double") / F.col("tx_count")).alias("average"),
        percent("amount", whole.select("a").scalar()).alias("amount_pct"),
        percent("tx_count", whole.select("n").scalar()).alias("count_pct"),
    )
    return closed, summary


def reconcile(accounts: DataFrame, tx: DataFrame, deposit: str) -> DataFrame:
    """Accounts whose stored balance is not the sum of their movements."""
    signed = F.when(F.col("type") == deposit, F.col("amount")).otherwise(-F.col("amount"))
    moved = tx.groupBy("account_id").agg(F.sum(signed).alias("moved"))
    rows = accounts.select("account_id", "balance").join(moved, "account_id", "left").withColumn(
        "moved", F.coalesce("moved", F.lit(0).cast("decimal(28,2)")))
    return rows.withColumn("difference", F.col("balance") - F.col("moved")).filter("difference <> 0")
