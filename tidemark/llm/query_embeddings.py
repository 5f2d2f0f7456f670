"""Near-duplicate links of all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.pivot_index import link_vectors


def op3_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return link_vectors(vectors).withColumnRenamed("id", "vec_id")


QUERIES = {"op3_embedding_links": op3_embedding_links}
ORACLES: dict[str, str] = {}
