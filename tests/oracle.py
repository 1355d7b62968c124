"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

import __spark_entry__ as entry_points


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return value


def _sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> tuple[int, list]:
    """Number of rows and the differing rows (Spark only, SQL only)."""
    df = entry_points.queries()[name](spark, folder)
    ours = _sorted_rows(df.columns, [tuple(row) for row in df.collect()])
    sql = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in sql.description]
    assert sorted(columns) == sorted(df.columns), (sorted(columns), sorted(df.columns))
    theirs = _sorted_rows(columns, sql.fetchall())
    if ours == theirs:
        return len(ours), []
    mine, other = set(map(repr, ours)) - set(map(repr, theirs)), set(map(repr, theirs)) - set(map(repr, ours))
    return len(ours), [len(theirs), sorted(mine)[:3], sorted(other)[:3]]
