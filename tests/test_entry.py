"""The registered queries agree with their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from checks.compare import TABLES, rows_of

@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(entry.Q.SPARK))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    assert got == want and got[1]


def test_every_query_has_sql():
    assert set(entry.Q.SPARK) == set(entry.Q.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
