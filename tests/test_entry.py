"""Every query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float) and value == int(value):
        return int(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return list(value) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def duck(base):
    con = duckdb.connect()
    for f in os.listdir(base):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{base}/{f}')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, base, name):
    df = QUERIES[name](spark, base)
    names = sorted(df.columns)
    got = sorted((repr([canonical(r[c]) for c in names]) for r in df.collect()))
    if name not in SQL:
        assert len(set(df.columns)) == len(df.columns)
        return
    rel = duck.execute(SQL[name])
    have = [d[0] for d in rel.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert sorted(repr([canonical(r[i]) for i in at]) for r in rel.fetchall()) == got


def test_entry(spark, base):
    assert entry.entry(spark).columns == ["table_name", "row_id", "known_date"]


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
