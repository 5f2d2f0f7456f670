"""Settings this library puts on a session that the caller owns.

Nothing here builds, stops or replaces a session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Parquet writes whose timestamps carry min/max statistics.
PARQUET_TIMESTAMP_SETTINGS = {
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.parquet.datetimeRebaseModeInWrite": "CORRECTED",
}

# Fixed value: the durable state store used unless a caller names another one.
STATE_STORE_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def configure(spark: SparkSession) -> SparkSession:
    """Put the parquet and state-store settings on ``spark`` and return it."""
    for key, value in PARQUET_TIMESTAMP_SETTINGS.items():
        spark.conf.set(key, value)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE_PROVIDER)
    return spark


@contextmanager
def session_conf(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[SparkSession]:
    """Hold ``settings`` on the session for one block, then put the old values back.

    Spark reads most SQL settings while a plan is analysed or a job starts, so
    the block must enclose the building of the DataFrame or the write itself.
    The settings are the session's: threads that share one need a session each
    (``spark.newSession()``) to keep theirs apart.
    """
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield spark
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    Only a local master may fall back to a fresh temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, grouped by application.

    Results may be read lazily, so nothing is removed here; ``clear_scratch``
    removes it all once they are no longer needed.
    """
    application = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/{application}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application has written under the shared folder.

    For the end of a job, as tables that queries returned may still be read from there.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_root(spark)}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh_name(stem: str) -> str:
    """A view or table name no other query uses."""
    return f"{stem}_{uuid.uuid4().hex[:12]}"
