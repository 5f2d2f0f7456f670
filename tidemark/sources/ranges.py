"""Generated rows and session views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def range_rows(spark: SparkSession, rows: int) -> DataFrame:
    """Rows ``id`` = 0 .. rows-1."""
    return spark.range(rows)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Make ``df`` readable as ``name`` in its session, replacing a view of that name."""
    df.createOrReplaceTempView(name)
    return df
