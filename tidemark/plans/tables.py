"""Access to the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import read_parquet

UTC = {"spark.sql.session.timeZone": "UTC"}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def load(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    return read_parquet(spark, table_path(sf_dir, name), spread)
