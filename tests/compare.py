"""Run a query in Spark and its SQL in DuckDB and compare rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row):
    return tuple((value is None, str(type(value)), value if value is not None else 0) for value in row)


def _clean(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_clean(row[i]) for i in order) for row in rows), key=_key
    )


def differences(df, con, statement: str, limit: int = 5) -> list[str]:
    """Empty when row count, column names and values agree."""
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    want_cols, want = table(names, result.fetchall())
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return [f"{len(bad)} of {len(got)} rows differ: {g} != {w}" for g, w in bad[:limit]]
