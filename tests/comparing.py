"""Rows of Spark and of DuckDB in one form."""

from __future__ import annotations

import decimal

import duckdb

from larkspur.session import TABLES


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def duck_rows(sf_dir, text):
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.sql(text)
        columns = sorted(found.columns)
        at = [found.columns.index(c) for c in columns]
        return columns, sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
