"""Every query with SQL for it gives what DuckDB gives on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

import __spark_entry__
from newsloom.fixtures import TABLES

QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(name, spark, sf, db):
    df = QUERIES[name](spark, sf)
    found = db.execute(SQL[name])
    columns = sorted(c[0] for c in found.description)
    assert sorted(df.columns) == columns
    order = [[c[0] for c in found.description].index(c) for c in columns]
    want = sorted(([plain(r[i]) for i in order] for r in found.fetchall()), key=str)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=str)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if q not in SQL and q != "pipeline" and not q.startswith("op")))
def test_gives_rows(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
