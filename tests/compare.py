"""Rows of a query against those of its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
from decimal import Decimal

import duckdb


def plain(x):
    if isinstance(x, Decimal | float):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6)
    return x


def same(df, sql: str, data: str) -> int:
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {p.split('/')[-1].removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want
    return len(got)
