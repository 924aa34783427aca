"""Runs catalogue queries in Spark and their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else int(value) if value == int(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    found = df.collect()
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    ours, theirs = rows_of(df.columns, found), rows_of(columns, rel.fetchall())
    if ours == theirs:
        return None if ours else "no rows"
    extra, missing = ours - theirs, theirs - ours
    return f"{sum(ours.values())} vs {sum(theirs.values())} rows; {sum(extra.values())} differ; " \
           f"ours {list(extra)[:2]} theirs {list(missing)[:2]}"
