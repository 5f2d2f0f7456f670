"""The cache lifecycle on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cache import cache_cycle as run_cycle
from tidemark.plans.tables import load
from tidemark.session import fresh_name
from tidemark.sources.ranges import register_view


def cache_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rounds of cache, count, uncache on ``orders``, and on a name that is missing."""
    view, missing = fresh_name("orders"), fresh_name("missing")
    register_view(load(spark, sf_dir, "orders"), view)
    try:
        outcome = run_cycle(spark, [view, missing], rounds=5)
    finally:
        spark.catalog.dropTempView(view)

    def plain(column: str):
        text = F.replace(F.col(column), F.lit(view), F.lit("orders"))
        return F.replace(text, F.lit(missing), F.lit("missing")).alias(column)

    return outcome.select("round", plain("table"), "rows", "status", plain("message"))


QUERIES = {"cache_cycle": cache_cycle}

ORACLES = {
    "cache_cycle": """
        SELECT CAST(r AS INTEGER) AS round, 'orders' AS "table",
               (SELECT count(*) FROM orders) AS "rows", 200 AS status,
               'Successfully uncached table: orders' AS message
        FROM (SELECT range AS r FROM range(1, 6))
        UNION ALL
        SELECT CAST(r AS INTEGER), 'missing', NULL, 404, 'Table not found: missing'
        FROM (SELECT range AS r FROM range(1, 6))
    """,
}
