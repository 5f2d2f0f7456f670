"""Language-model scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bloom_lm import score_documents


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs).withColumnRenamed("id", "doc_id")


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLES: dict[str, str] = {}
