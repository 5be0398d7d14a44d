"""Rows of a query as DuckDB and Spark give them, in one form."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return con


def _value(v):
    if isinstance(v, Decimal):
        return f"{v:.6f}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    return str(v)


def rows(names: list[str], found) -> list[tuple[str, ...]]:
    """Values by column name, in a fixed order of columns and rows."""
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_value(r[i]) for i in order) for r in found)


def differences(query, sql: str, spark, con, sf_dir: str) -> tuple[list, list]:
    """Rows that only Spark has, and rows that only DuckDB has."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    asked = con.execute(sql)
    names = [d[0] for d in asked.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, asked.fetchall())
    if got == want:
        return [], []
    return [r for r in got if r not in want][:3] or ["repeats"], [r for r in want if r not in got][:3] or ["repeats"]
