"""Settings as rows (``key``, ``value``), sorted by key, then value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.settings import merge_layers


def sorted_settings(pairs: DataFrame) -> DataFrame:
    """Two string columns in key order, the form every settings table has."""
    return pairs.select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    ).orderBy("key", "value")


def session_settings(spark: SparkSession, runtime: bool = False) -> DataFrame:
    """The settings the context was started with.

    ``runtime`` lays the session's present SQL settings over them.
    """
    started = spark.createDataFrame(
        spark.sparkContext.getConf().getAll(), "key string, value string"
    )
    if not runtime:
        return sorted_settings(started)
    present = spark.sql("SET").select("key", "value")
    layers = [
        present.select(F.lit("session").alias("scope"), F.lit(1).alias("priority"), "key", "value"),
        started.select(F.lit("session").alias("scope"), F.lit(2).alias("priority"), "key", "value"),
    ]
    return sorted_settings(merge_layers(layers))


def columns_as_settings(
    df: DataFrame, prefix: str, id_column: str, columns: Sequence[str]
) -> DataFrame:
    """One settings row per cell: ``prefix.<id>.<column>`` → value."""
    texts = df.select(
        F.col(id_column).cast("string").alias("__id"),
        *[F.col(name).cast("string").alias(name) for name in columns],
    )
    cells = texts.unpivot("__id", list(columns), "__column", "value")
    return sorted_settings(
        cells.select(F.concat_ws(".", F.lit(prefix), "__id", "__column").alias("key"), "value")
    )
