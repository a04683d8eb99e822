"""Runs a query on Spark and its SQL on DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

DATA = os.environ.get("SYLVA_TEST_DATA", "/root/testdata/sf0.001")


def connect(data: str = DATA):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        return _plain(v.tolist())
    if isinstance(v, list | tuple):
        return tuple(_plain(x) for x in v)
    return v


def rows(columns: list[str], records) -> list[str]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([_plain(r[k]) for k in order]) for r in records)


def difference(spark, con, query, sql: str, data: str = DATA) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, data)
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, got.fetchall())
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} and {len(b)} rows; only on Spark {only_a}; only in SQL {only_b}"
