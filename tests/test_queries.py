"""Every query with SQL gives the same rows as DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from skyloom.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return "nan" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((plain(tuple(r)) for r in df.select(*cols).collect()), key=repr)
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == cols
    at = [result.columns.index(c) for c in cols]
    assert mine == sorted((plain(tuple(r[i] for i in at)) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
