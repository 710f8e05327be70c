"""Every registered query of the engine against DuckDB on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from lodestone import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("key", sorted(queries.queries()))
def test_equals_duckdb(spark, duck, key):
    df = queries.queries()[key](spark, DATA)
    names = sorted(df.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*names).collect())
    if key not in queries.oracle():
        assert got
        return
    want = duck.sql(queries.oracle()[key])
    assert sorted(want.columns) == names
    rows = duck.sql(f"SELECT {', '.join(names)} FROM ({queries.oracle()[key]})").fetchall()
    assert got == sorted(repr(tuple(map(plain, r))) for r in rows)
