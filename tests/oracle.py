"""Runs a query and its DuckDB oracle over one scale and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("PLEXORA_DATA", "/root/testdata")


def connect(scale: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/{scale}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return con


def norm(x):
    if x is None or isinstance(x, bool):
        return x
    if isinstance(x, float):
        if math.isnan(x):
            return "nan"
        if x == 0:  # a negative zero is another value to whoever compares bytes
            return "-0" if math.copysign(1.0, x) < 0 else 0.0
        return float(f"{x:.9g}")
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    if hasattr(x, "tzinfo") and x.tzinfo:
        return x.replace(tzinfo=None)
    return x


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, name: str, query, sql: str, scale: str, con=None):
    df = query(spark, f"{DATA}/{scale}")
    got = rows(df.columns, df.collect())
    cur = (con or connect(scale)).execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols), (name, df.columns, cols)
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    assert len(got) == len(want) and not diff, (name, len(got), len(want), diff[:3] or (got[-2:], want[-2:]))
    return len(got)
