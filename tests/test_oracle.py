"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare
from tidemark.plans.registry import QUERIES
from tidemark.plans.tables import BASE

FOLDER = "/root/testdata/sf0.001"
CHECKS = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in BASE:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    message, good = compare(spark, db, FOLDER, name, entry.queries()[name], CHECKS.get(name))
    assert good, message
    assert "rows=0" not in message


def test_every_query_has_sql():
    assert set(QUERIES) <= set(CHECKS)


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns[:2] == ["Ticker", "Date"]
    assert frame.count() == 120
