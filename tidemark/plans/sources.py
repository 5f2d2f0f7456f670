"""Sources and sinks on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.cache import cache_table, count_rows, uncache_tables
from tidemark.plans.tables import UTC, load
from tidemark.session import fresh_name, scratch_path, session_conf
from tidemark.sources.clustered import row_groups, skipping, write_clustered
from tidemark.sources.files import (
    read_whole_text,
    split_documents,
    write_documents,
    write_parquet,
)
from tidemark.sources.framed import read_framed, write_framed
from tidemark.sources.ranges import range_rows, register_view
from tidemark.sources.settings_table import columns_as_settings
from tidemark.sources.tables import drop_table, save_table


def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range as long as ``orders``: viewed, cached, counted from memory, uncached."""
    rows = range_rows(spark, load(spark, sf_dir, "orders").count())
    view = fresh_name("numbers")
    register_view(rows, view)
    try:
        cache_table(spark, view)
        try:
            cached = count_rows(spark, view)
        finally:
            uncache_tables(spark, [view])
        return spark.table(view).agg(
            F.lit(cached).cast("bigint").alias("n_cached"),
            F.count(F.lit(1)).alias("n"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
        )
    finally:
        spark.catalog.dropTempView(view)


def config_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's columns as sorted settings rows."""
    return columns_as_settings(
        load(spark, sf_dir, "customer"), "customer", "c_custkey",
        ["c_name", "c_nationkey", "c_mktsegment"],
    )


def whole_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settings document per supplier, written to files and read back whole."""
    suppliers = load(spark, sf_dir, "supplier")
    documents = suppliers.select(
        F.concat(
            F.lit("supplier:\n  key: "), F.col("s_suppkey").cast("string"),
            F.lit("\n  name: "), "s_name",
            F.lit("\n  nation: "), F.col("s_nationkey").cast("string"),
        ).alias("document"),
    )
    path = scratch_path(spark, "whole-text")
    write_documents(documents, "document", path)
    key = F.regexp_extract("content", r"key: (\d+)", 1).cast("bigint")
    return split_documents(read_whole_text(spark, path)).select(key.alias("s_suppkey"), "content")


def whole_text_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All document texts through framed files: some null, empty, with CRLF, or lines of dashes."""
    number = F.col("doc_id")
    texts = load(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(number % 7 == 0, F.lit(None)).when(number % 7 == 1, "")
        .when(number % 7 == 2, F.concat(F.lit("---\r\n"), "text", F.lit("\r\n")))
        .when(number % 7 == 3, F.concat("text", F.lit("\n---\n---")))
        .otherwise(F.col("text")).alias("content"),
    )
    path = scratch_path(spark, "framed")
    write_framed(texts, "content", path, key="doc_id")
    return read_framed(spark, path).select(F.col("key").cast("bigint").alias("doc_id"), "content")


def _events_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "events")
    write_parquet(events, path, sort_within=["ts"])
    return spark.read.parquet(path)


def parquet_ts_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through parquet with timestamp statistics, and back."""
    with session_conf(spark, UTC):
        return _events_rewritten(spark, sf_dir).select(
            "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"),
            "user_id", "event_type", "value", "props",
        )


def parquet_ts_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week of events, read by skipping the row groups outside it."""
    with session_conf(spark, UTC):
        week = _events_rewritten(spark, sf_dir).where(
            (F.col("ts") >= F.lit("2024-01-08").cast("timestamp"))
            & (F.col("ts") < F.lit("2024-01-15").cast("timestamp"))
        )
        return week.groupBy("event_type").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.col("ts").cast("timestamp_ntz")).alias("first_ts"),
            F.max(F.col("ts").cast("timestamp_ntz")).alias("last_ts"),
        )


# The week and the users of the skipping report.
WEEK = (1_704_672_000_000_000, 1_705_276_799_999_999)
USERS = (20, 34)
CLUSTERED_FILES = 144


def parquet_skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events clustered by time and user: the rows of one week and some users, and whether a
    reader of them may skip over nine tenths of the row groups."""
    with session_conf(spark, UTC):
        events = load(spark, sf_dir, "events").select(
            "event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
        path = scratch_path(spark, "clustered")
        total = events.count()
        write_clustered(events, ["ts", "user_id"], path, rows_per_file=-(-total // CLUSTERED_FILES))
        groups = skipping(row_groups(spark, path, ["ts", "user_id"]), {"ts": WEEK, "user_id": USERS})
        share = groups.agg(
            (F.sum(F.col("kept").cast("int")) * 10 < F.count(F.lit(1))).alias("skips_nine_tenths"),
            (F.sum("rows") == total).alias("all_rows_in_groups")).first()
        first, last = (F.timestamp_micros(F.lit(at)) for at in WEEK)
        return spark.read.parquet(path).where(
            F.col("ts").between(first, last) & F.col("user_id").between(*USERS)
        ).agg(
            F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event")
        ).withColumns({name: F.lit(value) for name, value in share.asDict().items()})


def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders saved as a catalog table, counted from it by status, and dropped."""
    name = fresh_name("orders_saved")
    saved = save_table(
        load(spark, sf_dir, "orders"), name, path=scratch_path(spark, "orders-table")
    )
    try:
        return saved.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    finally:
        drop_table(spark, name)


QUERIES = {
    "range_count": range_count,
    "config_table": config_table,
    "whole_text": whole_text,
    "whole_text_exact": whole_text_exact,
    "parquet_ts_roundtrip": parquet_ts_roundtrip,
    "parquet_ts_range": parquet_ts_range,
    "parquet_skip_report": parquet_skip_report,
    "catalog_roundtrip": catalog_roundtrip,
}

ORACLES = {
    "range_count": """
        SELECT count(*) AS n_cached, count(*) AS n, min(id) AS first_id, max(id) AS last_id
        FROM (SELECT range AS id FROM range((SELECT count(*) FROM orders)))
    """,
    "config_table": """
        SELECT 'customer.' || c_custkey || '.c_name' AS key, c_name AS value FROM customer
        UNION ALL
        SELECT 'customer.' || c_custkey || '.c_nationkey', CAST(c_nationkey AS VARCHAR)
        FROM customer
        UNION ALL
        SELECT 'customer.' || c_custkey || '.c_mktsegment', c_mktsegment FROM customer
    """,
    "whole_text": """
        SELECT s_suppkey,
               'supplier:' || chr(10) || '  key: ' || s_suppkey || chr(10)
               || '  name: ' || s_name || chr(10) || '  nation: ' || s_nationkey || chr(10) AS content
        FROM supplier
    """,
    "whole_text_exact": """
        SELECT doc_id,
               CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ''
                    WHEN 2 THEN '---' || chr(13) || chr(10) || text || chr(13) || chr(10)
                    WHEN 3 THEN text || chr(10) || '---' || chr(10) || '---'
                    ELSE text END AS content
        FROM documents
    """,
    "parquet_ts_roundtrip": """
        SELECT event_id, ts, user_id, event_type, value, props FROM events
    """,
    "parquet_ts_range": """
        SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
        FROM events
        WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'
        GROUP BY event_type
    """,
    "parquet_skip_report": """
        SELECT count(*) AS n, min(event_id) AS first_event, true AS skips_nine_tenths,
               (SELECT count(*) FROM events) > 0 AS all_rows_in_groups
        FROM events
        WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'
          AND user_id BETWEEN 20 AND 34
    """,
    "catalog_roundtrip": """
        SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus
    """,
}
