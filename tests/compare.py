"""Compare a query with its SQL counterpart: column names, row count and all values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def assert_same(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> int:
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    expected = sorted_rows(columns, result.fetchall())
    actual = sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    assert sorted(df.columns) == sorted(columns)
    assert len(actual) == len(expected)
    for mine, theirs in zip(actual, expected):
        assert mine == theirs
    return len(actual)
