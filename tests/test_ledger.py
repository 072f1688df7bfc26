"""Posting rules against a plain loop."""

import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerkit.operators import ledger

REQ = "request_id long, account_id int, day date, amount decimal(18,2)"
ACC = "account_id int, client_id int, type string, state string, balance decimal(18,2)"


def loop(requests, accounts, limit):
    """The rules applied one request after the other."""
    left, used, out = {a: b for a, b, s in accounts if s == "ACTIVE"}, {}, {}
    known = {a for a, _, _ in accounts}
    for rid, acc, day, amount in sorted(requests, key=lambda r: (r[2], r[0])):
        spent = used.get((acc, day), 0)
        if amount <= 0:
            out[rid] = "AMOUNT"
        elif acc not in known:
            out[rid] = "UNKNOWN_ACCOUNT"
        elif acc not in left:
            out[rid] = "NOT_ACTIVE"
        elif amount <= left[acc] and spent + amount <= limit:
            left[acc] -= amount
            used[acc, day] = spent + amount
            out[rid] = "ACCEPTED"
        else:
            out[rid] = "LIMIT"
    return out


@pytest.mark.parametrize("seed,group_rows", [(1, 1_000_000), (2, 6)])
def test_withdrawals_in_order(spark, seed, group_rows):
    rng = random.Random(seed)
    accounts = [(1, Decimal(9000), "ACTIVE"), (2, Decimal(400), "ACTIVE"), (3, Decimal(5000), "BLOCKED"), (4, Decimal(700), "ACTIVE")]
    requests = []
    for rid in range(160):
        acc = 1 if rid % 3 else rng.choice([2, 3, 4, 99])
        amount = Decimal(rng.choice([-5, 30, 80, 250, 600, 950, 1200])) + Decimal(rng.randrange(100)) / 100
        requests.append((rid, acc, date(2024, 1, 1 + rid // 40), amount))
    df = spark.createDataFrame(requests, REQ)
    acc = spark.createDataFrame(accounts, "account_id int, balance decimal(18,2), state string")
    got = ledger.post_withdrawals(df, acc, ["request_id"], 1000, group_rows=group_rows)
    assert {r["request_id"]: r["status"] for r in got.collect()} == loop(requests, accounts, 1000)


def test_alternating_amounts_in_a_hot_group_take_the_known_rounds(spark, monkeypatch):
    """One, all that is left, one, all that is left: a run of one row after the other."""
    rows = [(i, 1, 1 if i % 2 == 0 else 1000 - i // 2, 1000) for i in range(40)]
    walks = []
    walk = ledger._accept_in_stream
    monkeypatch.setattr(ledger, "_accept_in_stream", lambda *a: walks.append(1) or walk(*a))
    df = spark.createDataFrame(rows, "id long, g long, cents long, room long")
    got = {r["id"]: r["accepted"] for r in ledger.accept_in_order(df, ["g"], ["id"], group_rows=10).collect()}
    left, want = 1000, {}
    for i, _, cents, _ in rows:
        want[i] = cents <= left
        left -= cents if want[i] else 0
    assert got == want and len(walks) == 1 + 4  # the groups walked whole, and 40 rows in slices of 10


@pytest.mark.parametrize("group_rows", [1_000_000, 4])
def test_transfers_in_order(spark, group_rows):
    rng = random.Random(7)
    state = {1: Decimal(100), 2: Decimal(100), 5: Decimal(900)}
    requests = [(i, rng.choice([1, 1, 1, 2, 5, 77]), rng.choice([1, 2, 3, 5, 99]), Decimal(rng.choice([-1, 5, 30, 80, 95])))
                for i in range(60)]
    acc = spark.createDataFrame(
        [(k, 1, "CURRENT", "ACTIVE", v) for k, v in state.items()] + [(3, 1, "CURRENT", "CLOSED", Decimal(0))], ACC)
    df = spark.createDataFrame(requests, "request_id long, source int, dest int, amount decimal(18,2)")
    got = ledger.post_transfers(df, acc, ["request_id"], group_rows=group_rows)
    want, left = {}, dict(state)
    for rid, source, dest, amount in requests:
        code = (50001 if amount <= 0 else 50003 if source == dest else 50004 if source not in left
                else 50007 if left[source] < amount else 50008 if dest == 99 else 50009 if dest == 3 else None)
        if code is None:
            left[source] -= amount
        want[rid] = code
    assert {r["request_id"]: r["code"] for r in got.collect()} == want
    after = ledger.apply_postings(acc, got.filter("code IS NULL"))
    assert after.filter("balance < 0").count() == 0


def accounts(spark):
    return spark.createDataFrame([
        (1, 1, "SAVINGS", "ACTIVE", Decimal("5000")), (2, 1, "CURRENT", "ACTIVE", Decimal("100")),
        (3, 2, "CURRENT", "BLOCKED", Decimal("900")), (4, 2, "TERM", "ACTIVE", Decimal("80000")),
        (5, 3, "SAVINGS", "ACTIVE", Decimal("-20")), (6, 3, "SAVINGS", "CLOSED", Decimal("0")),
    ], ACC)


def test_transfer_codes(spark):
    cases = [
        (1, 2, "500", None), (1, 2, "-100", 50001), (1, 2, "1000000.01", 50002), (1, 1, "5", 50003), (999, 2, "5", 50004),
        (3, 2, "5", 50005), (4, 2, "5", 50006), (2, 1, "999", 50007), (1, 888, "5", 50008), (1, 6, "5", 50009),
    ]
    req = spark.createDataFrame(
        [(i, s, d, Decimal(a)) for i, (s, d, a, _) in enumerate(cases)], "request_id int, source int, dest int, amount decimal(18,2)")
    got = ledger.validate_transfers(req, accounts(spark))
    assert {r["request_id"]: r["code"] for r in got.collect()} == {i: c[3] for i, c in enumerate(cases)}
    assert set(ledger.CODES) == {c[3] for c in cases if c[3]}


def test_deposits(spark):
    req = spark.createDataFrame([
        (1, Decimal(75000), "CASH"), (1, Decimal(75000), "CHEQUE"), (1, Decimal(0), "CASH"), (1, Decimal(5), "GOLD"),
        (3, Decimal(5), "CASH"), (77, Decimal(5), "CASH"), (1, Decimal(5), None),
    ], "account_id int, amount decimal(18,2), origin string")
    got = ledger.validate_deposits(req, accounts(spark), ["CASH", "CHEQUE"])
    assert sorted(r["status"] for r in got.collect()) == [
        "AMOUNT", "NEEDS_APPROVAL", "NOT_ACTIVE", "OK", "ORIGIN", "ORIGIN", "UNKNOWN_ACCOUNT"]


def test_postings_keep_the_total(spark):
    moves = spark.createDataFrame([(1, 2, Decimal("10.55")), (2, 1, Decimal("3")), (1, 4, Decimal("100"))], "source int, dest int, amount decimal(18,2)")
    assert ledger.legs(moves).agg(F.sum("change")).first()[0] == 0
    after = {r["account_id"]: r["balance"] for r in ledger.apply_postings(accounts(spark), moves).collect()}
    assert after[1] == Decimal("4892.45") and after[2] == Decimal("107.55") and after[3] == Decimal(900)


def test_spread_sums_to_zero(spark):
    before = accounts(spark)
    after = ledger.spread_amount(before, 1, "100.00")
    got = {r["account_id"]: r["balance"] for r in after.collect()}
    assert got[1] == Decimal(4900) and got[3] == Decimal(900)
    assert [got[2], got[4], got[5]] == [Decimal("133.34"), Decimal("80033.33"), Decimal("13.33")]


def test_block_and_low_balance(spark):
    acc = accounts(spark).withColumn("last_move", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))
    states = {r["account_id"]: r["state"] for r in ledger.block_negative(acc, "2024-03-01").collect()}
    assert states[5] == "BLOCKED" and states[1] == "ACTIVE"
    low = {r["account_id"]: r["alert"] for r in ledger.low_balance_alerts(accounts(spark), 500).collect()}
    assert low == {2: "LOW", 5: "OVERDRAWN", 6: "LOW"}


def test_reconcile_and_close(spark):
    tx = spark.createDataFrame([
        (1, "A", "O", Decimal(5000), "2024-01-05 10:00:00"), (2, "A", "F", Decimal(150), "2024-01-05 23:59:00"),
        (2, "N", "O", Decimal(50), "2024-01-06 00:00:00"),
    ], "account_id int, type string, state string, amount decimal(18,2), ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    off = {r["account_id"]: r["difference"] for r in ledger.reconcile(accounts(spark), tx, "A").collect()}
    assert off == {3: 900, 4: 80000, 5: -20}
    closed, summary = ledger.close_day(tx, "2024-01-05", "O", "F")
    assert sorted(r["state"] for r in closed.collect()) == ["F", "F", "O"]
    row = summary.first()
    assert (row["tx_count"], row["amount"], row["amount_pct"]) == (2, 5150, 100.0)
