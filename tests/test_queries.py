"""Every registered query against its SQL, and the entry points."""

import pytest

import __spark_entry__ as entry
from checks import MODULES
from checks.compare import compare, database
from ledgerkit.operators import ordered

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return database(sf)


def test_every_query_has_sql():
    for module in MODULES:
        assert set(module.SQL) == set(module.QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, con, name):
    assert compare(spark, con, sf, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", ["top_clients", "client_ranks", "number_rows", "percentiles", "string_agg_all", "versions", "travel"])
def test_query_with_everything_sliced(spark, sf, con, name, monkeypatch):
    """The same rows when nearly every key counts as hot."""
    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 10)
    assert compare(spark, con, sf, QUERIES[name], SQL[name]) is None
