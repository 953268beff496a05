"""Compare a query with its oracle, row by row, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """(matches, message) for a Spark result and the oracle's SQL."""
    result = con.sql(sql)
    expected_columns = result.columns
    expected = rows_of(expected_columns, result.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(expected_columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(expected_columns)}"
    if got != expected:
        diff = [(a, b) for a, b in zip(got, expected) if a != b][:2]
        return False, f"{len(got)} rows vs {len(expected)}; first differences {diff}"
    return True, f"{len(got)} rows"
