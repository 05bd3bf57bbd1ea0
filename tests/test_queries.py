"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans.queries import QUERIES
from plumbline.plans.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "-"
    if isinstance(x, bool | str):
        return str(x)
    return f"{float(x):.5f}".replace("-0.00000", "0.00000")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows
    if name in SQL:
        found = db.sql(SQL[name])
        assert sorted(found.columns) == columns
        assert sorted(tuple(plain(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()) == rows


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
