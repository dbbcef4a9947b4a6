"""Compares each query with its SQL in DuckDB; columns by name, rows in any order."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def sql_rows(root: str, sql: str):
    con = duckdb.connect()
    for p in Path(root).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    got = con.sql(sql)
    return got.columns, [dict(zip(got.columns, r)) for r in got.fetchall()]


def compare(spark, f, sql: str, root: str) -> str | None:
    """What differs, or None."""
    df = f(spark, root)
    columns, want = sql_rows(root, sql)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    order = sorted(columns)
    key = lambda rows: sorted((tuple(norm(r[c]) for c in order) for r in rows), key=repr)
    a, b = key([r.asDict() for r in df.collect()]), key(want)
    if a == b:
        return None
    both = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"{len(a)} and {len(b)} rows; {both}"[:600]
