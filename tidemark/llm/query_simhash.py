"""SimHash groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.simhash import simhash_groups


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_groups(docs).select(F.col("id").alias("doc_id"), "fingerprint", "component_id")


QUERIES = {"op6_simhash": op6_simhash}
ORACLES: dict[str, str] = {}
