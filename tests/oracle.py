"""Comparing a registered query with its SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, (int, float)):
        return round(float(value), 6)
    return str(value)


def table_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(cells, key=lambda r: tuple((c is None, str(type(c)), str(c)) for c in r))


def differences(df, con, sql: str) -> list[str]:
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    relation = con.execute(sql)
    want_columns, want = [c[0] for c in relation.description], relation.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return [f"columns {sorted(got_columns)} against {sorted(want_columns)}"]
    left, right = table_of(got_columns, got), table_of(want_columns, want)
    found = []
    if len(left) != len(right):
        found.append(f"{len(left)} rows against {len(right)}")
    missing = [r for r in left if r not in right][:3] if len(left) < 5000 else [a for a, b in zip(left, right) if a != b][:3]
    extra = [r for r in right if r not in left][:3] if len(right) < 5000 else [b for a, b in zip(left, right) if a != b][:3]
    for r in missing:
        found.append(f"only here: {r}")
    for r in extra:
        found.append(f"only in SQL: {r}")
    return found
