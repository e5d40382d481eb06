"""Rows of a registered query and of its SQL, made comparable."""

from __future__ import annotations

import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf)):
        path = f"{sf}/{name}/*.parquet" if os.path.isdir(f"{sf}/{name}") else f"{sf}/{name}"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (datetime, date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return x


def ordered(columns, rows):
    """Rows with their columns by name, in a stable order."""
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(row[k]) for k in at) for row in rows), key=repr)


def compare(spark, query, sql: str, sf: str) -> tuple[int, int, list, list]:
    """(rows of the query, rows of the SQL, a few rows only in the one, a few only in the other)."""
    found = query(spark, sf)
    got = ordered(found.columns, [tuple(x) for x in found.collect()])
    con = connect(sf)
    answer = con.execute(sql)
    names = [c[0] for c in answer.description]
    want = ordered(names, answer.fetchall())
    con.close()
    if sorted(found.columns) != sorted(names):
        return len(got), len(want), [tuple(sorted(found.columns))], [tuple(sorted(names))]
    if got == want:
        return len(got), len(want), [], []
    a, b = set(got), set(want)
    extra, missing = [x for x in got if x not in b], [x for x in want if x not in a]
    if not extra and not missing:
        extra = ["rows repeat differently"]
    return len(got), len(want), extra[:3] or ["-"], missing[:3] or ["-"]
