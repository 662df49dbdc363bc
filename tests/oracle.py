"""Compares a query with its SQL twin."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

import duckdb


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        path = os.path.join(sf_dir, f)
        if os.path.isdir(path):
            path += "/*.parquet"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def difference(df, c, sql: str) -> tuple[Counter, Counter]:
    """Rows only Spark has, rows only SQL has."""
    names = sorted(df.columns)
    got = c.execute(sql)
    there = [d[0] for d in got.description]
    assert sorted(there) == names, (names, sorted(there))
    at = [there.index(n) for n in names]
    a = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    b = Counter(tuple(plain(r[i]) for i in at) for r in got.fetchall())
    return a - b, b - a
