"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows, whatever their order."""

from __future__ import annotations

import decimal
import math
import os
from pathlib import Path

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def rows_of_sql(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    found = views(sf_dir).execute(sql)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(plain(r[i]) for i in order) for r in found.fetchall()]


def difference(df, sf_dir: str, sql: str) -> str:
    """What differs, or an empty string."""
    names, want = rows_of_sql(sf_dir, sql)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} and {names}"
    got = [tuple(plain(r[c]) for c in names) for r in df.collect()]
    key = lambda r: tuple((x is None, str(type(x)) if x is None else "", str(x)) for x in r)
    got, want = sorted(got, key=key), sorted(want, key=key)
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows; first {got[:2]} and {want[:2]}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(wrong)} of {len(got)} rows differ, such as {wrong[:3]}" if wrong else ""
