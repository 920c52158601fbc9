"""Run queries beside their SQL in DuckDB and compare rows."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.01"


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def spark_rows(df):
    names = sorted(df.columns)
    kinds = dict(df.dtypes)
    return names, [kinds[n] for n in names], sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = sorted(rel.columns)
    at = [rel.columns.index(n) for n in names]
    kinds = [str(rel.types[i]) for i in at]
    return names, kinds, sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP", "date": "DATE"}


def differences(df, con, sql) -> str:
    """Empty if both have the same columns, types and rows."""
    names, kinds, rows = spark_rows(df)
    names2, kinds2, rows2 = duck_rows(con, sql)
    if names != names2:
        return f"columns {names} {names2}"
    odd = [(n, a, b) for n, a, b in zip(names, kinds, kinds2) if a in SAME and SAME[a] != b]
    if odd:
        return f"types {odd}"
    if len(rows) != len(rows2):
        return f"{len(rows)} rows, {len(rows2)} in SQL"
    bad = [(a, b) for a, b in zip(rows, rows2) if a != b]
    return f"{len(bad)} of {len(rows)} rows differ, as {bad[0]}" if bad else ""
