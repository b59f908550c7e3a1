"""Run a query in Spark and its SQL in DuckDB over the same parquet and compare all rows."""

from __future__ import annotations

import math
from datetime import date, datetime

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return round(value, 6) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    shaped = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(shaped, key=repr)


def difference(frame, connection, sql: str) -> str | None:
    """None if both sides agree, else the first difference in words."""
    theirs = connection.execute(sql)
    their_names = [d[0] for d in theirs.description]
    their_columns, their_rows = _sorted(their_names, theirs.fetchall())
    our_columns, our_rows = _sorted(frame.columns, [tuple(r) for r in frame.collect()])
    if our_columns != their_columns:
        return f"columns {our_columns} != {their_columns}"
    if len(our_rows) != len(their_rows):
        return f"{len(our_rows)} rows != {len(their_rows)} rows"
    for ours, other in zip(our_rows, their_rows):
        if [type(v) for v in ours] != [type(v) for v in other] or ours != other:
            return f"{ours} != {other}"
    return None
