"""Streams over the given tables, run to the end of the available input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.settings import filter_names
from tidemark.plans.tables import UTC, load, table_path
from tidemark.session import fresh_name, scratch_path, session_conf
from tidemark.streaming.chains import group_count, last_before
from tidemark.streaming.joins import chain_within, once_per_period
from tidemark.streaming.manifest import lay_out, stream_manifest
from tidemark.streaming.runner import Run, run_stream, state_partitions
from tidemark.streaming.sources import stream_parquet
from tidemark.streaming.state import state_rows

CHAIN = ("view", "click", "purchase")
CHAIN_BATCHES = 3
# Two days in seconds: how long a step may come after the one before it.
WITHIN = 2 * 86_400
# 2024-01-11 and 2024-01-21, where the batches of the state query begin.
STATE_CUTS = (1_704_931_200_000_000, 1_705_795_200_000_000)


def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours in which a user viewed, then clicked, then purchased, each within two days."""
    return chain_run(spark, sf_dir, CHAIN_BATCHES)[0]


def chain_run(
    spark: SparkSession, sf_dir: str, batches: int, period: str = "hour"
) -> tuple[DataFrame, Run]:
    """Two stateful joins in a row over the distinct periods of each step, and how they ran.

    The events are first laid out by time, so they can be taken in ``batches``
    steps of which none holds rows the watermark has passed. State older than
    the bounds goes with each step.
    """
    with session_conf(spark, UTC):
        layout = lay_out(_steps(spark, sf_dir), "ts", scratch_path(spark, "chain-events"), batches)
        events = stream_manifest(spark, layout)

        def step(kind: str) -> tuple[DataFrame, str]:
            rows = events.where(F.col("event_type") == kind).select(
                "user_id", F.col("ts").alias(f"{kind}_time"))
            return once_per_period(rows, "user_id", f"{kind}_time", period, "3 days"), f"{kind}_time"

        chain = chain_within([step(kind) for kind in CHAIN], "user_id", "2 DAYS")
        output, run = run_stream(
            chain, "stream-chain", batches=layout.batches,
            state_partitions=state_partitions(spark, layout.rows))
        return output.select("user_id", *[f"{kind}_time" for kind in CHAIN]), run


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").where(F.col("event_type").isin(*CHAIN)).select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


def stream_chain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's last click before it, and the last view before that one."""
    return chain_events_run(spark, sf_dir, CHAIN_BATCHES)[0]


def chain_events_run(spark: SparkSession, sf_dir: str, batches: int) -> tuple[DataFrame, Run]:
    """Single events chained by a keyed state processor, each within two days, and how it ran.

    Batches follow each other in time, so the watermark needs no delay; a closing
    row lets it pass the last events, whose state then goes too.
    """
    with session_conf(spark, UTC):
        layout = lay_out(_steps(spark, sf_dir), "ts", scratch_path(spark, "chain-events"), batches,
                         closing=2 * WITHIN)
        events = stream_manifest(spark, layout).withWatermark("ts", "0 seconds")
        chain = last_before(events, "user_id", "ts", "event_type", CHAIN, WITHIN, group_count(layout.rows))
        return run_stream(
            chain, "stream-events", batches=layout.batches,
            state_partitions=state_partitions(spark, layout.rows))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the distinct hours of users keep as state after each batch, before and after the
    watermark has passed them."""
    with session_conf(spark, UTC):
        events = load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
        layout = lay_out(events, "ts", scratch_path(spark, "state-events"), cuts=STATE_CUTS)
        hours = once_per_period(stream_manifest(spark, layout), "user_id", "ts", "hour", "1 day")
        _, run = run_stream(hours, "stream-state", batches=layout.batches,
                            state_partitions=state_partitions(spark, layout.rows))
        held = [state_rows(spark, run.checkpoint, batch=batch) for batch in range(run.batches)]
        rows = held[0]
        for one in held[1:]:
            rows = rows.unionByName(one)
        hour = F.unix_micros("key.ts")
        return rows.groupBy("batch").agg(
            F.count(F.lit(1)).alias("n_keys"), F.min(hour).alias("first_hour"), F.max(hour).alias("last_hour"))


def stream_name_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name filter on a stream."""
    events = stream_parquet(spark, table_path(sf_dir, "events"))
    kept = filter_names(
        events.select("event_id", "event_type", "value"), "event_type",
        match=["view"], regex="^p(.*)$",
    )
    output, _ = run_stream(kept, "stream-names")
    return output


def stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that each batch of a stream reports to the driver, summed."""
    name = fresh_name("report")
    events = stream_parquet(spark, table_path(sf_dir, "events")).select("event_id", "event_type")
    watched = events.observe(
        name, F.sum(F.col("event_id") * 10).alias("total"), F.count(F.lit(1)).alias("n")
    )
    _, run = run_stream(watched, "stream-report")
    return spark.createDataFrame(
        [tuple(run.total(name, metric) for metric in ("total", "n"))],
        "total bigint, n bigint",
    )


QUERIES = {
    "stream_chain": stream_chain,
    "stream_chain_events": stream_chain_events,
    "stream_state": stream_state,
    "stream_name_filter": stream_name_filter,
    "stream_report": stream_report,
}

ORACLES = {
    "stream_chain": """
        WITH hours AS (
            SELECT DISTINCT user_id, event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h
            FROM events
        )
        SELECT v.user_id, epoch_us(v.h) AS view_time, epoch_us(c.h) AS click_time,
               epoch_us(p.h) AS purchase_time
        FROM hours v
        JOIN hours c ON c.user_id = v.user_id AND c.h BETWEEN v.h AND v.h + INTERVAL 2 DAY
        JOIN hours p ON p.user_id = v.user_id AND p.h BETWEEN c.h AND c.h + INTERVAL 2 DAY
        WHERE v.event_type = 'view' AND c.event_type = 'click' AND p.event_type = 'purchase'
    """,
    "stream_chain_events": """
        WITH clicks AS (
            SELECT c.user_id, c.ts, CASE WHEN c.ts - v.ts <= INTERVAL 2 DAY THEN v.ts END AS view_ts
            FROM (SELECT user_id, ts FROM events WHERE event_type = 'click') c
            ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'view') v
            ON c.user_id = v.user_id AND c.ts > v.ts
        )
        SELECT p.user_id,
               epoch_us(CASE WHEN p.ts - c.ts <= INTERVAL 2 DAY THEN c.view_ts END) AS view_time,
               epoch_us(CASE WHEN p.ts - c.ts <= INTERVAL 2 DAY THEN c.ts END) AS click_time,
               epoch_us(p.ts) AS purchase_time
        FROM (SELECT user_id, ts FROM events WHERE event_type = 'purchase') p
        ASOF LEFT JOIN clicks c ON p.user_id = c.user_id AND p.ts > c.ts
    """,
    "stream_state": """
        WITH hours AS (
            SELECT DISTINCT user_id, date_trunc('hour', ts) AS h,
                   CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 0
                        WHEN ts < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END AS b
            FROM events
        ), batches AS (
            SELECT n.batch, (SELECT max(h) FROM hours WHERE b < n.batch) - INTERVAL 1 DAY AS passed
            FROM (SELECT unnest([0, 1, 2, 3]) AS batch) n
        )
        SELECT CAST(batch AS INTEGER) AS batch, count(*) AS n_keys,
               epoch_us(min(h)) AS first_hour, epoch_us(max(h)) AS last_hour
        FROM batches JOIN hours ON b <= batch AND (passed IS NULL OR h > passed)
        GROUP BY batch
    """,
    "stream_name_filter": """
        SELECT event_id, event_type, value FROM events
        WHERE event_type = 'view' OR regexp_matches(event_type, '^p(.*)$')
    """,
    "stream_report": """
        SELECT CAST(sum(event_id * 10) AS BIGINT) AS total, count(*) AS n FROM events
    """,
}
