"""Runs a query and its SQL side by side, on the same Parquet tables."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(folder: str):
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _key(row):
    return tuple((v is None, str(round(v, 6)) if isinstance(v, float) else str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def differences(frame, sql: str, folder: str) -> str:
    """Empty if names and rows agree; else what differs first."""
    result = oracle(folder).execute(sql)
    names = [d[0] for d in result.description]
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} and {sorted(names)}"
    order = sorted(names)
    expected = sorted(([row[names.index(c)] for c in order] for row in result.fetchall()), key=_key)
    found = sorted(([row[c] for c in order] for row in frame.collect()), key=_key)
    if len(found) != len(expected):
        return f"{len(found)} rows for {len(expected)}"
    return next((f"{a} for {b}" for a, b in zip(found, expected, strict=True) if not all(map(_same, a, b))), "")
