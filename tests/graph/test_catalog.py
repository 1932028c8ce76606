import math
import os

import duckdb
import pytest

from codeloom.catalog import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.environ.get('SF_DIR', DATA)}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.12g}" if math.isfinite(v) else str(v)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries()))
def test_equals_sql(spark, duck, name):
    got = queries()[name](spark, os.environ.get("SF_DIR", DATA))
    data = [tuple(r) for r in got.collect()]
    if name not in oracle_sql():
        assert got.columns
        return
    want = duck.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())
