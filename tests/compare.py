"""Runs a registered query and its SQL on the same Parquet files and compares all values."""

from __future__ import annotations

import datetime
import decimal
import pathlib
from collections import Counter

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(pathlib.Path(folder).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_cell(row[i]) for i in order) for row in rows]


def differences(spark_df, connection, sql: str) -> list[str]:
    """Rows of one side that the other lacks, as multisets; every value must be equal and of the same type."""
    got = rows_of(spark_df.columns, spark_df.collect())
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return [f"columns {sorted(spark_df.columns)} != {sorted(names)}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    typed = [Counter((row, tuple(type(v) for v in row)) for row in side) for side in (got, want)]
    spare = [list((typed[i] - typed[1 - i]).elements()) for i in (0, 1)]
    spare = [sorted((row for row, _ in side), key=str) for side in spare]
    return [f"{len(spare[0])} of {len(got)} rows differ, {sorted(names)}: {g} != {w}" for g, w in list(zip(*spare))[:3]]
