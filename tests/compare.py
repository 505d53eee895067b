"""Rows of a Spark query against rows of the same question in DuckDB."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted(rel.columns), sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=str)


def same(df, sf_dir: str, sql: str) -> None:
    columns, rows = oracle(sf_dir, sql)
    assert sorted(df.columns) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == rows
