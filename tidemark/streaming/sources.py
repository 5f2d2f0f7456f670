"""File streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_GLOB = set("{}[]*?,\\")


def literal_path(spark: SparkSession, path: str) -> str:
    """``path`` in full, in a form that Spark's file sources take for itself and no pattern.

    A path without special characters that names a folder stays as it is. A lone
    file becomes a pattern that only it matches, as the stream source takes no
    other form of it. A path that is not there is refused.
    """
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(found):
        raise FileNotFoundError(path)
    full = system.makeQualified(found).toString()
    escaped = "".join("\\" + one if one in _GLOB else one for one in full)
    if escaped == full and not system.getFileStatus(found).isDirectory():
        parent, _, name = full.rpartition("/")
        # A class of one letter makes it a pattern; braces do where there is no letter.
        at = next((at for at, one in enumerate(name) if one.isalnum()), None)
        name = f"{{{name}}}" if at is None else f"{name[:at]}[{name[at]}]{name[at + 1:]}"
        escaped = f"{parent}/{name}"
    return escaped


def stream_parquet(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream over the parquet file or folder at ``path``, which may be relative.

    Without ``schema`` the one found there now is taken. ``files_per_trigger``
    bounds a batch; files then arrive by modification time (see
    ``arrange_by_time``). A path that is not there is refused.
    """
    literal = literal_path(spark, path)
    reader = spark.readStream.schema(schema or spark.read.parquet(literal).schema)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(literal)


def arrange_by_time(df: DataFrame, time: str, path: str, files: int) -> None:
    """Write ``df`` to ``files`` files under ``path`` that follow each other in ``time``.

    Rows are dealt to files by ranges of time. As a stream takes files by when
    they were modified, the files are then given times a second apart, in the
    order of their ranges: bounded batches of the stream advance in event time,
    and no row comes after the watermark has passed it. The store must let files'
    times be set, as HDFS and local file systems do.
    """
    spark = df.sparkSession
    df.repartitionByRange(files, time).sortWithinPartitions(time).write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    written = [one for one in system.listStatus(folder) if one.getPath().getName().startswith("part-")]
    written.sort(key=lambda one: one.getPath().getName())
    last = max((one.getModificationTime() for one in written), default=0)
    for number, one in enumerate(written):
        when = last - 1000 * (len(written) - 1 - number)
        system.setTimes(one.getPath(), when, -1)
        if system.getFileStatus(one.getPath()).getModificationTime() // 1000 != when // 1000:
            raise RuntimeError(f"the times of files under {path} cannot be set")
