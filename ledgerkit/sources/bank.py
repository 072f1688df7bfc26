"""The bank star (clients, accounts, transactions, log) over the given tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerkit.session import has_file
from ledgerkit.sources.readers import load, write_lookup

MONEY = "decimal(18,2)"

# What identifies a transaction; also the tie-break of every order by time.
TX_ID = ["account_id", "line", "part_id", "supplier_id"]


@dataclass(frozen=True)
class Bank:
    clients: DataFrame
    accounts: DataFrame
    tx: DataFrame


def money(name: str) -> Column:
    return F.col(name).cast(MONEY)


def clients(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("branch_id"),
        money("c_acctbal").alias("credit"),
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("account_id"), F.col("o_custkey").alias("client_id"),
        F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("type"),
        money("o_totalprice").alias("balance"), F.col("o_orderdate").alias("opened"),
    )


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("account_id"), F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("state"),
        money("l_extendedprice").alias("amount"), F.col("l_shipdate").alias("ts"),
    )


def activity(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as an audit, access or device log."""
    return load(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("account_id"), "ts",
        F.col("event_type").alias("kind"), money("value").alias("amount"), "props",
    )


def bank(spark: SparkSession, folder: str) -> Bank:
    return Bank(clients(spark, folder), accounts(spark, folder), transactions(spark, folder))


def lookup_bank(spark: SparkSession, folder: str, path: str) -> Bank:
    """The star in files for reading single accounts and clients; written below ``path`` when they are not there.

    Accounts lie by account, with a Bloom filter on the client; transactions carry their client and lie by client,
    account and time, with a Bloom filter on the account. Write to a new path when the tables have changed.
    """
    plain = bank(spark, folder)
    tables = {
        "clients": lambda at: write_lookup(plain.clients, at, ["client_id"]),
        "accounts": lambda at: write_lookup(plain.accounts, at, ["account_id"], ["client_id"]),
        "tx": lambda at: write_lookup(
            plain.tx.join(plain.accounts.select("account_id", "client_id"), "account_id", "left"), at,
            ["client_id", "account_id", "ts"], ["account_id"]),
    }
    for name, write in tables.items():
        if not has_file(spark, f"{path}/{name}/_SUCCESS"):
            write(f"{path}/{name}")
    return Bank(*[spark.read.parquet(f"{path}/{name}") for name in tables])
