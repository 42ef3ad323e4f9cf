"""Every query against its SQL, over the smallest tables."""

import math
import os

import duckdb
import pytest

from foliant.plans.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "none"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs
