"""Byte-level BPE over all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import encode_documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = encode_documents(
        docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
        results=("ids_sha256", "decoded_sha256"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op8_byte_bpe": op8_byte_bpe}
ORACLES: dict[str, str] = {}
