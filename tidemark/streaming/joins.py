"""Stream-stream joins bounded in event time, made to be chained."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once_per_period(
    df: DataFrame, key: str, time: str, period: str, delay: str
) -> DataFrame:
    """The distinct (``key``, period start) of a stream, emitted when first seen.

    The start keeps the column name ``time`` and carries the watermark, so state
    is dropped ``delay`` after the period. Rows are made distinct within their
    Arrow batch before the shuffle, so a key that holds much of the stream
    neither fills one task nor reaches a later join more than once per period.
    """
    starts = df.select(key, F.date_trunc(period, F.col(time)).alias(time))
    combined = starts.mapInArrow(_distinct_within_batch(), starts.schema)
    return combined.withWatermark(time, delay).dropDuplicates([key, time])


def _distinct_within_batch():
    # A nested function travels by value, so executors need only pyarrow.
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            kept = rows.group_by(rows.column_names).aggregate([])
            yield from kept.combine_chunks().to_batches()

    return distinct


def follow_within(
    left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str
) -> DataFrame:
    """Pairs with equal ``key`` where right happens from left until ``within`` later.

    Both sides carry a watermark on their time, so Spark can drop state that no
    later row can meet. Of the event-time columns only ``right_time`` leaves the
    join as a time; ``left_time`` leaves as microseconds. That way the result can
    enter another join, which accepts one event-time column per side.
    """
    other = right.withColumnRenamed(key, "__key")
    condition: Column = (
        (F.col(key) == F.col("__key"))
        & (F.col(right_time) >= F.col(left_time))
        & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    )
    return (
        left.join(other, condition)
        .drop("__key")
        .withColumn(left_time, F.unix_micros(left_time))
    )


def chain_within(
    steps: list[tuple[DataFrame, str]], key: str, within: str
) -> DataFrame:
    """``follow_within`` over several (stream, time column) steps, one after another."""
    (current, current_time), *rest = steps
    for following, time in rest:
        current = follow_within(current, following, key, current_time, time, within)
        current_time = time
    return current.withColumn(current_time, F.unix_micros(current_time))
