"""Comparison of a Spark result with DuckDB over the same parquet files."""

from __future__ import annotations

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Spark type → the DuckDB types that hold the same values.
SAME_TYPE = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "string": {"VARCHAR"}, "double": {"DOUBLE"},
    "boolean": {"BOOLEAN"}, "timestamp_ntz": {"TIMESTAMP"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _key(row):
    return tuple((value is not None, str(type(value)), value) for value in row)


def differences(df, connection, sql: str) -> list[str]:
    """What differs, in words; empty if names, types and rows agree."""
    found = []
    shape = connection.execute(f"DESCRIBE {sql}").fetchall()
    sql_types = {row[0]: row[1] for row in shape}
    names = sorted(df.columns)
    if names != sorted(sql_types):
        return [f"columns {names} and {sorted(sql_types)}"]
    for name, kind in df.dtypes:
        if sql_types[name] not in SAME_TYPE.get(kind, {kind.upper()}):
            found.append(f"{name}: {kind} and {sql_types[name]}")
    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    columns = ", ".join(f'"{n}"' for n in names)
    theirs = sorted(
        connection.execute(f"SELECT {columns} FROM ({sql})").fetchall(), key=_key
    )
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} and {len(theirs)} rows")
    elif ours != theirs:
        first = next((a, b) for a, b in zip(ours, theirs) if a != b)
        found.append(f"first differing rows {first}")
    return found
