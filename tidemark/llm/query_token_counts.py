"""Token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.token_boundaries import count_tokens

RANKS = "byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50256


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = count_tokens(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, SEPARATOR)
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
