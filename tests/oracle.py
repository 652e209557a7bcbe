"""Runs a query and its SQL side by side: rows as sorted tuples, columns by name."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x) if x is not None and type(x).__name__ in ("Decimal", "date", "datetime", "Timestamp") else x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in data], key=repr)


def connect(sf: str):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def compare(spark, sf: str, name: str, query, sql: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, sf)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(sf).execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        a, b = set(map(repr, mine)), set(map(repr, theirs))
        return f"{name}: {len(mine)} and {len(theirs)} rows; only here {sorted(a - b)[:3]}, only there {sorted(b - a)[:3]}"
    return ""
