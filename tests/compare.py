"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(folder) / name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def normalised(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr(tuple(_cell(r[i]) for i in order)) for r in rows)


def difference(spark_df, con, sql: str) -> str:
    """'' if both sides hold the same rows, else a short account."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    want_cols, want_rows = normalised(names, want.fetchall())
    got_cols, got_rows = normalised(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got_rows == want_rows:
        return "" if got_rows else "both sides are empty"
    got, want_set = set(got_rows), set(want_rows)
    return (
        f"{len(got_rows)} rows != {len(want_rows)} rows; only Spark: {sorted(got - want_set)[:2]}; "
        f"only SQL: {sorted(want_set - got)[:2]}"
    )
