"""Joins to a table that is usually, but not provably, small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024
ROW_BYTES = 16


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row: fixed for numbers, by length for text, as JSON for what is nested."""
    size = F.lit(ROW_BYTES * len(df.columns)).cast("bigint")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind == "variant" or kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return size


def lookup_bytes(lookup: DataFrame, key: str) -> int:
    """Rough in-memory size of ``lookup``; refuses one that repeats a key that is not null.

    One job on the cluster, of which a single row comes back.
    """
    keys = lookup.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(row_bytes(lookup)).alias("bytes"))
    found = keys.agg(F.max("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    if (found["rows"] or 0) > 1:
        raise ValueError(f"the lookup has several rows for one {key}")
    return found["bytes"] or 0


def join_lookup(
    df: DataFrame, lookup: DataFrame, key: str, limit_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """Left join ``df`` to ``lookup``, which has at most one row per ``key``; null keys join nothing.

    ``lookup`` is measured first and broadcast only within ``limit_bytes``.
    Beyond that both sides are shuffled by key, once. The rows of a hot key then
    fill one partition, which adaptive execution splits, equal rows too, as it
    deals out the blocks that the map tasks wrote.
    """
    return join_measured(df, lookup, key, lookup_bytes(lookup, key), limit_bytes)


def join_measured(
    df: DataFrame, lookup: DataFrame, key: str, size: int, limit_bytes: int = BROADCAST_LIMIT_BYTES
) -> DataFrame:
    """``join_lookup`` where the lookup's size is known and its keys are single."""
    lookup = lookup.where(F.col(key).isNotNull())
    return df.join(F.broadcast(lookup) if size <= limit_bytes else lookup, key, "left")
