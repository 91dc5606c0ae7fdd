"""The catalog's queries against the same in SQL, at the smallest scale, whatever else is there."""

import decimal
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from paperloom.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float | decimal.Decimal):
        return repr(round(float(v), 6))
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, DATA)
    rows = df.collect()
    if name not in catalog.SQL:
        assert rows
        return
    cursor = db.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark):
    df = catalog.field_search_filter(spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "p_retailprice" not in plan
