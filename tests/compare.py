"""Runs a query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def table(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    """Columns by name and rows in a fixed order."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(plain, key=repr)


def spark_table(df):
    return table(df.columns, df.collect())


def duck_table(connection, sql: str):
    result = connection.execute(sql)
    return table([column[0] for column in result.description], result.fetchall())
