"""Runs queries and their SQL side by side and compares their rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    try:
        return round(float(x), 9) + 0.0
    except (TypeError, ValueError):
        return str(x)


def same(df, con, sql: str) -> tuple[bool, str]:
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != columns:
        return False, f"columns {sorted(names)} and {columns}"
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    if mine != theirs:
        odd = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
        return False, f"{len(mine)} and {len(theirs)} rows; first difference {odd}"
    return True, f"{len(mine)} rows"
