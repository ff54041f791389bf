"""Compares a Spark result with DuckDB's on the same Parquet tables: columns by name, rows as a sorted bag."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, Decimal):
        return round(float(x), 9)
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def bag(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_bag(df) -> tuple[list[str], list[tuple]]:
    return bag(df.columns, [tuple(r) for r in df.collect()])


def duck_bag(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    return bag([d[0] for d in got.description], got.fetchall())


def difference(a: tuple[list[str], list[tuple]], b: tuple[list[str], list[tuple]]) -> str:
    """Empty if equal, else what differs first."""
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    odd = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(odd)} rows differ, first {str(odd[0])[:600]}" if odd else ""
