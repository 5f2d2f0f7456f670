"""Cache lifecycle of catalog tables and views, with the outcome as a table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

# Status codes and messages of an uncache request.
UNCACHED, NOT_FOUND = 200, 404
UNCACHED_MESSAGE = "Successfully uncached table: {}"
NOT_FOUND_MESSAGE = "Table not found: {}"

STATUS_SCHEMA = "`table` string, status int, message string"
CYCLE_SCHEMA = "round int, `table` string, `rows` bigint, status int, message string"


def cache_table(
    spark: SparkSession, name: str, storage_level: StorageLevel | None = None
) -> None:
    """Mark ``name`` for caching; the next scan of the same plan fills the cache."""
    if storage_level is None:
        spark.catalog.cacheTable(name)
    else:
        spark.catalog.cacheTable(name, storage_level)


def count_rows(spark: SparkSession, name: str) -> int:
    """Count ``name``, from memory where it is cached."""
    return spark.table(name).count()


def _uncache(spark: SparkSession, name: str) -> tuple[str, int, str]:
    if not spark.catalog.tableExists(name):
        return name, NOT_FOUND, NOT_FOUND_MESSAGE.format(name)
    spark.catalog.uncacheTable(name)
    return name, UNCACHED, UNCACHED_MESSAGE.format(name)


def uncache_tables(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """Uncache each table and say how it went: (``table``, ``status``, ``message``).

    A table that exists but is not cached counts as uncached. A name may carry
    its database (``db.t``).
    """
    return spark.createDataFrame([_uncache(spark, name) for name in names], STATUS_SCHEMA)


def cache_cycle(spark: SparkSession, names: Iterable[str], rounds: int = 5) -> DataFrame:
    """Cache, count and uncache every table ``rounds`` times.

    One row per round and table. A missing table has no row count.
    """
    outcome = []
    names = list(names)
    for number in range(1, rounds + 1):
        for name in names:
            rows = None
            try:
                if spark.catalog.tableExists(name):
                    cache_table(spark, name)
                    rows = count_rows(spark, name)
            finally:
                table, status, message = _uncache(spark, name)
            outcome.append((number, table, rows, status, message))
    return spark.createDataFrame(outcome, CYCLE_SCHEMA)
