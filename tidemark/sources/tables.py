"""Tables of the session catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import PARQUET_TIMESTAMP_SETTINGS, session_conf


def save_table(
    df: DataFrame,
    name: str,
    table_format: str = "parquet",
    mode: str = "errorifexists",
    path: str | None = None,
) -> DataFrame:
    """Save ``df`` as catalog table ``name`` and return the table.

    Without ``path`` the files go to the session's warehouse. Other formats
    (``delta``) work where the session has their package.
    """
    writer = df.write.format(table_format).mode(mode)
    if path is not None:
        writer = writer.option("path", path)
    with session_conf(df.sparkSession, PARQUET_TIMESTAMP_SETTINGS):
        writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_bucketed(
    df: DataFrame,
    name: str,
    by: Sequence[str],
    buckets: int,
    path: str,
    mode: str = "errorifexists",
) -> DataFrame:
    """Save ``df`` as a catalog table in ``buckets`` hash buckets by ``by``, sorted within them.

    Rows are shuffled here, once; joins and aggregations by these columns, with
    tables of as many buckets, then shuffle nothing. A bucket is one file, so it
    is read in its order. Take so many buckets that one fits a task. A null in
    ``by`` meets nothing in a join, so it is refused.
    """
    whole = reduce(Column.__and__, [F.col(one).isNotNull() for one in by])
    told = F.lit(f"a row of {name} has no {' or no '.join(by)}")
    rows = df.where(F.when(whole, True).otherwise(F.raise_error(told).isNotNull()))
    writer = (
        rows.repartition(buckets, *by).write.format("parquet").mode(mode).option("path", path)
        .bucketBy(buckets, by[0], *by[1:]).sortBy(by[0], *by[1:])
    )
    with session_conf(df.sparkSession, PARQUET_TIMESTAMP_SETTINGS):
        writer.saveAsTable(name)
    return df.sparkSession.table(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """Forget table ``name``; files under an own ``path`` stay."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
