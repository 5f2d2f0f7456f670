"""Toxicity scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import remainder
from tidemark.llm.toxicity import FOLDS, HELD_OUT, score_toxicity, train

# Fixed value: the threshold of the query's contract.
THRESHOLD = 0.3


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = score_toxicity(docs, train(docs, labels))
    return scores.select(
        F.col("id").alias("doc_id"),
        (remainder(F.col("id"), FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLES: dict[str, str] = {}
