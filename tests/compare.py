"""Rows of Spark and of DuckDB in one form, so that they can be held against each other."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if hasattr(value, "as_tuple"):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def as_rows(columns, rows):
    """Columns by name; rows sorted."""
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def of_spark(df):
    return as_rows(df.columns, df.collect())


def of_duckdb(sql: str, folder: str):
    with duckdb.connect() as db:
        for name in TABLES:
            path = Path(folder, f"{name}.parquet")
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/*.parquet')" if path.is_dir() else f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
        found = db.execute(sql)
        return as_rows([c[0] for c in found.description], found.fetchall())
