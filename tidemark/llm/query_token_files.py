"""All documents' token ids through the file format."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.token_files import token_file_round_trip

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_file_round_trip(docs, public_tokenizers.path(TOKENIZER), END_ID, crc32=True)


QUERIES = {"op9_token_files": op9_token_files}
ORACLES: dict[str, str] = {}
