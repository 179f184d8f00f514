"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import canonical

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in os.listdir(SF_DIR):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return connection


def test_sql_belongs_to_queries():
    assert SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("key", QUERIES)
def test_query(spark, con, key):
    got = QUERIES[key](spark, SF_DIR).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if key in SQL:
        want = canonical(con.execute(SQL[key]).df())
        got = canonical(got)
        assert list(got.columns) == list(want.columns)
        assert got.equals(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_id", "term", "query", "value"]
