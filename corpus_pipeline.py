"""A corpus through four operators: toxicity, near copies, benchmark passages, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.byte_bpe import encode_documents
from tidemark.llm.common import kept
from tidemark.llm.decontaminate import drop_contaminated
from tidemark.llm.query_bpe import RANKS
from tidemark.llm.simhash import drop_near_copies
from tidemark.llm.toxicity import drop_toxic, train


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier accepts by their language's threshold."""
    return drop_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row, and the sums of them and of what they decode to."""
    found = encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN,
                             results=("ids", "ids_sha256", "decoded_sha256"))
    return found.withColumnRenamed("id", "doc_id")


STAGES = (
    ("toxicity", without_toxic),
    ("near copies", without_copies),
    ("decontamination", without_benchmark),
    ("token ids", with_ids),
)

# A trained model and a Python encoder decide; SQL cannot say the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
