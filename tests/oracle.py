"""Runs a registered query and its oracle SQL and compares names, row counts and values."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal | float | int):
        return f"{float(v):.9g}"
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(str(plain(r[i])) for i in order) for r in rows])


def difference(spark, sf_dir: str, query, sql: str, con=None) -> str | None:
    """None if both agree, else what differs first."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = (con or connection(sf_dir)).execute(sql)
    theirs = rows_of([d[0] for d in got.description], got.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows and {len(theirs[1])}; e.g. {[x for x in mine[1] if x not in set(theirs[1])][:2]} / {[x for x in theirs[1] if x not in set(mine[1])][:2]}"
    for a, b in zip(mine[1], theirs[1], strict=True):
        if a != b:
            return f"{a} and {b}"
    return None
