"""Compare a query with its SQL on DuckDB: column names, row count and values in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(frame, con, sql: str) -> str | None:
    """None if equal, else a short description."""
    cursor = con.execute(sql)
    want_names = [d[0] for d in cursor.description]
    want = rows_of(want_names, cursor.fetchall())
    got = rows_of(frame.columns, frame.collect())
    if sorted(frame.columns) != sorted(want_names):
        odd = set(frame.columns) ^ set(want_names)
        return f"columns differ: {sorted(odd)}"
    if got != want:
        names = sorted(want_names)
        extra, missing = list((got - want).items())[:2], list((want - got).items())[:2]
        text = f"rows {sum(got.values())} vs {sum(want.values())}"
        if extra and missing:
            cells = [
                (n, x, y) for n, x, y in zip(names, extra[0][0], missing[0][0]) if x != y
            ]
            text += f"; first pair differs in {cells[:6]}"
        return f"{text}; only here {extra}; only there {missing}"
    return None
