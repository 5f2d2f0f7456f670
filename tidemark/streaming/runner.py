"""Running a stream to the end of its available input, with durable state."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.session import (
    PARQUET_TIMESTAMP_SETTINGS,
    STATE_STORE_PROVIDER,
    scratch_path,
    session_conf,
)

# Commit small change logs instead of whole state snapshots, and keep the four
# stores of a stream join in one.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}

# Spark keeps the progress of its last batches only; whether there is more is asked far more often.
POLL_SECONDS = 0.02
# Rows of a stream that make a task of its state worth while, and those that one takes well: each
# store of each step costs some tenths of a second to load and commit in each batch, full or not.
STATE_ROWS = 1 << 13
FULL_STATE_ROWS = 1 << 18

def state_partitions(spark: SparkSession, rows: int) -> int:
    """Tasks for the state of a stream of ``rows``: by its size, within what the session allows.

    A checkpoint keeps this number, and each stateful step pays for each of its
    stores in each batch, so a small stream has few, a larger one as many as
    there are cores, and then as many times that as its size takes.
    """
    cores = spark.sparkContext.defaultParallelism
    allowed = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
    rounds = max(1, -(-rows // (FULL_STATE_ROWS * cores)))
    return max(1, min(allowed, cores * rounds, -(-rows // STATE_ROWS)))


# Settings of state retention a caller may pass, by short name.
RETENTION_SETTINGS = {
    "minBatchesToRetain": "spark.sql.streaming.minBatchesToRetain",
    "minDeltasForSnapshot": "spark.sql.streaming.stateStore.minDeltasForSnapshot",
    "maintenanceInterval": "spark.sql.streaming.stateStore.maintenanceInterval",
    "compactOnCommit": "spark.sql.streaming.stateStore.rocksdb.compactOnCommit",
}


def start_stream(
    df: DataFrame,
    output: str,
    checkpoint: str,
    name: str | None = None,
    state_provider: str = STATE_STORE_PROVIDER,
    state_partitions: int | None = None,
    retention: dict[str, object] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start ``df`` into parquet files at ``output``, over all input now available.

    A stream over a manifest needs ``available_now`` off, as it gives a batch a
    trigger; ``finish`` then has to be told how many there are.

    ``checkpoint`` and ``output`` belong in storage all executors share: a
    restart, or a replaced executor, goes on from there. ``state_partitions``
    is fixed by the first start of a checkpoint. The query keeps the settings
    it was started with; the session gets its own back.
    """
    settings = {
        **PARQUET_TIMESTAMP_SETTINGS,
        **STATE_SETTINGS,
        "spark.sql.streaming.stateStore.providerClass": state_provider,
    }
    if state_provider != STATE_STORE_PROVIDER:
        # One store for a whole join needs column families, which only RocksDB has.
        del settings["spark.sql.streaming.join.stateFormatVersion"]
    if state_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(state_partitions)
    for short, value in (retention or {}).items():
        settings[RETENTION_SETTINGS[short]] = str(value)
    writer = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="0 seconds")
    if name is not None:
        writer = writer.queryName(name)
    with session_conf(df.sparkSession, settings):
        return writer.start()


class Run:
    """Running sums of a query's batches, taken while it runs.

    ``dropped`` rows came after the watermark had passed them; ``batches``
    counts batches, ``peak_state`` and ``last_state`` are rows of state, and
    ``checkpoint`` is where they are kept (see ``state.state_rows``).
    """

    def __init__(self, query: StreamingQuery, first_batch: int | None = None) -> None:
        self.query = query
        self.checkpoint: str | None = None
        self.next_batch = first_batch
        self.batches = self.dropped = self.peak_state = self.last_state = 0
        self.ends: list = []
        self._totals: dict[tuple[str, str], int] = {}

    def take(self) -> None:
        """Add the batches that ended since the last call; refuses a gap between them."""
        last = self.query._jsq.lastProgress()
        if last is None or (self.next_batch is not None and last.batchId() < self.next_batch):
            return
        # All are fetched as text before any is read: Spark's history may be short.
        for text in [one.json() for one in self.query._jsq.recentProgress()]:
            progress = json.loads(text)
            number = progress["batchId"]
            if self.next_batch is not None and number < self.next_batch:
                continue
            if self.next_batch is not None and number > self.next_batch:
                raise RuntimeError(f"the progress of batch {self.next_batch} was not seen")
            self.next_batch = number + 1
            self.batches += 1
            self.ends = [source["endOffset"] for source in progress["sources"]]
            steps = progress["stateOperators"]
            self.dropped += sum(one["numRowsDroppedByWatermark"] for one in steps)
            self.last_state = sum(one["numRowsTotal"] for one in steps)
            self.peak_state = max(self.peak_state, self.last_state)
            for name, metrics in progress.get("observedMetrics", {}).items():
                for metric, value in metrics.items():
                    if isinstance(value, (int, float)):
                        held = self._totals.get((name, metric), 0)
                        self._totals[name, metric] = held + value

    def total(self, name: str, metric: str) -> int:
        """The sum of one observed metric over all batches of this run."""
        return self._totals.get((name, metric), 0)


def finish(
    query: StreamingQuery,
    timeout: float | None = None,
    first_batch: int | None = None,
    batches: int | None = None,
) -> Run:
    """Wait for the query and sum up its batches.

    A failure is raised; an overrun stops the query and is raised. Sums are
    taken from Spark's short history of batches as the query goes on, so a run
    may have any number of them. With ``batches``, those of the manifest that it
    follows, the query is stopped once they and what they set off are done.
    """
    run = Run(query, first_batch)
    end = None if timeout is None else time.monotonic() + timeout
    while not query.awaitTermination(POLL_SECONDS):
        run.take()
        if batches == 0 or batches and run.ends and all(at["batch"] >= batches for at in run.ends):
            query.processAllAvailable()
            run.take()
            query.stop()
            break
        if end is not None and time.monotonic() > end:
            query.stop()
            raise TimeoutError(f"stream {query.name or query.id} ran over {timeout} s")
    run.take()
    return run


def run_stream(
    df: DataFrame,
    name: str,
    timeout: float | None = None,
    on_late: str = "fail",
    batches: int | None = None,
    **options,
) -> tuple[DataFrame, Run]:
    """Run ``df`` into fresh shared folders; its output as a table, and the run's sums.

    Rows that came too late for the watermark are missing from the output. They
    fail the run, unless ``on_late`` is "report"; then ``dropped`` counts them.
    """
    if on_late not in ("fail", "report"):
        raise ValueError("on_late is 'fail' or 'report'")
    spark: SparkSession = df.sparkSession
    output = scratch_path(spark, f"{name}-output")
    checkpoint = scratch_path(spark, f"{name}-state")
    query = start_stream(df, output, checkpoint, available_now=batches is None, **options)
    run = finish(query, timeout, first_batch=0, batches=batches)
    run.checkpoint = checkpoint
    if run.dropped and on_late == "fail":
        raise RuntimeError(f"stream {name} dropped {run.dropped} rows that came after the watermark")
    return spark.read.schema(df.schema).parquet(output), run
