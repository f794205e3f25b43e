"""Every query with an oracle gives the oracle's rows, on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value.isoformat() if isinstance(value, datetime.date) else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_its_oracle(spark, duck, name):
    found = __spark_entry__.queries()[name](spark, FOLDER)
    expected = duck.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    places = [expected.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[k]) for k in places) for r in expected.fetchall()), key=repr)


def test_the_flagship_query_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
