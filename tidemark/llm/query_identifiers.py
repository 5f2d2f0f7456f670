"""Personal data in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.identifiers import DETECTORS, find_identifiers


def _told(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda one: F.concat_ws(
        ":", one.kind, one.start.cast("string"), one.stop.cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda one: one.kind == kind)).cast("long").alias(f"n_{kind}")


def op13_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_identifiers(docs).withColumn("base", F.filter("spans", lambda one: one.plain))
    return found.select(
        F.col("id").alias("doc_id"), *[_count(F.col("base"), kind) for kind in DETECTORS],
        F.sha2(_told(F.col("base")), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))


QUERIES = {"op13_identifiers": op13_identifiers}
ORACLES: dict[str, str] = {}
