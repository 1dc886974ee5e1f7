"""Row-by-row comparison of a Spark result with a DuckDB statement."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((type(_plain(row[i])).__name__, _plain(row[i])) for i in order) for row in rows)


def differences(frame: DataFrame, connection: duckdb.DuckDBPyConnection, statement: str) -> str:
    """Empty when names, types and all values agree exactly, else what differs."""
    result = connection.execute(statement)
    names = [column[0] for column in result.description]
    expected = _rows(names, result.fetchall())
    found = _rows(frame.columns, frame.collect())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} instead of {sorted(names)}"
    if expected == found:
        return ""
    missing, extra = list((expected - found).items()), list((found - expected).items())
    return f"{len(missing)} missing, {len(extra)} extra\nmissing {missing[:2]}\nextra   {extra[:2]}"
