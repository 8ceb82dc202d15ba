"""Runs a query and its oracle SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """What differs between a DataFrame and an oracle result; None when they are equal."""
    got_columns, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    want_columns, want = _rows([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} vs {want_columns}"
    spark_kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in df.dtypes:
        if spark_kinds.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} vs {kinds[name]}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want), key=repr)[:2], sorted(set(want) - set(got), key=repr)[:2]
        return f"{len(got)} rows vs {len(want)}; only spark {extra[0]}, only oracle {extra[1]}"
    for a, b in zip(got, want):
        if a != b:
            return f"spark {a} vs oracle {b}"
    return None
