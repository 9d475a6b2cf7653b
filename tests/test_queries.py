"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith(("op", "pipeline")))


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS FROM '{DATA}/{t}'")
    return con


def value(x):
    return ("nan" if math.isnan(x) else repr(x + 0.0)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sql, name):
    df = entry.queries()[name](spark, DATA)
    want = sql.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(value(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(value(r[i]) for i in at) for r in want.fetchall())
