"""Compares a query with its SQL on the smallest test data."""

from __future__ import annotations

import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(DATA.glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(cell, v))
    return v


def assert_same(spark, con, query, sql):
    df = query(spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted(str(tuple(cell(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(str(tuple(cell(dict(zip(names, r))[c]) for c in cols)) for r in cur.fetchall())
    assert got == want
