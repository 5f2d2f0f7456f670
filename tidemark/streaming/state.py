"""The state that a stream has kept in its checkpoint, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stateful_steps(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful steps of a checkpoint: ``operatorId``, ``operatorName``, ``stateStoreName``,
    ``numPartitions``, and the batches whose state can still be read."""
    return spark.read.format("state-metadata").load(checkpoint)


def state_rows(
    spark: SparkSession,
    checkpoint: str,
    step: int = 0,
    batch: int | None = None,
    variable: str | None = None,
    side: str | None = None,
) -> DataFrame:
    """One stateful step's rows as they were after ``batch``, the last one without it.

    Columns are ``step``, ``batch`` (null for the last), ``partition``, ``key`` and
    ``value``. ``variable`` names one variable of a keyed state processor; a stream
    join is read one ``side`` ("left" or "right") at a time. Only what the checkpoint still
    retains can be read (``minBatchesToRetain``). The rows are read by Spark's own
    state source, a task a partition of the state; nothing of the stream runs.
    """
    reader = spark.read.format("statestore").option("operatorId", step)
    options = {"batchId": batch, "stateVarName": variable, "joinSide": side}
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, value)
    found = reader.load(checkpoint)
    # A list or a map of a processor has columns of its own for what it holds.
    held = [name for name in found.columns if name not in ("key", "partition_id")]
    value = F.col(held[0]) if len(held) == 1 else F.struct(*held)
    return found.select(
        F.lit(step).alias("step"), F.lit(batch).cast("int").alias("batch"),
        F.col("partition_id").alias("partition"), "key", value.alias("value"))
