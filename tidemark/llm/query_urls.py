"""The URL filter over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.url_rules import Rule, filter_urls

# The rules of the query's contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, RULES).withColumnRenamed("id", "page_id")


QUERIES = {"op4_url_filter": op4_url_filter}

ORACLES = {
    "op4_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), judged AS (
            SELECT page_id, host, path,
                   CASE
                     WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%'
                       THEN 'www.example.com/en/'
                     WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%'
                       THEN 'example.com/en/'
                     WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
                     WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
                     WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/'
                   END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/')
                    THEN 'block' ELSE 'allow' END AS verdict
        FROM judged
    """,
}
