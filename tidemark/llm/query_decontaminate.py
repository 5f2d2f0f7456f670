"""Benchmark passages in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import find_contamination


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    names = F.sort_array(F.transform("item_ids", lambda item: item.cast("string")))
    return find_contamination(docs, benchmark).select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op2_decontamination": op2_decontamination}

_WORDS = r"""
    regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
"""

ORACLES = {
    "op2_decontamination": f"""
        WITH items AS (
            SELECT item_id, {_WORDS} AS words FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(len(words), 10) AS size,
                   array_to_string(list_slice(words, pos, pos + least(len(words), 10) - 1), ' ') AS run
            FROM items, LATERAL (SELECT unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS pos)
            WHERE len(words) > 0
        ), docs AS (
            SELECT doc_id, {_WORDS} AS words FROM documents
        ), runs AS (
            SELECT doc_id, pos, size, array_to_string(list_slice(words, pos, pos + size - 1), ' ') AS run
            FROM docs, (SELECT DISTINCT size FROM windows),
                 LATERAL (SELECT unnest(range(1, len(words) - size + 2)) AS pos)
        ), found AS (
            SELECT doc_id, pos, runs.size AS size, item_id
            FROM runs JOIN windows ON runs.run = windows.run AND runs.size = windows.size
        ), hit AS (
            SELECT doc_id, count(DISTINCT pos + plus) AS n_hit
            FROM (SELECT doc_id, pos, unnest(range(0, size)) AS plus FROM found)
            GROUP BY doc_id
        ), named AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names
            FROM found GROUP BY doc_id
        )
        SELECT docs.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
}
