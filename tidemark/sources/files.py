"""File sources and sinks: parquet with usable timestamp statistics, whole text files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import PARQUET_TIMESTAMP_SETTINGS, session_conf


# Spark cuts no scan into parts of under a few MB, so smaller tables sit in a few tasks.
SPREAD_BELOW_BYTES = 256 * 1024 * 1024


def read_parquet(spark: SparkSession, path: str, spread: bool = False) -> DataFrame:
    """Read a parquet file or folder.

    ``spread`` is for work that costs far more per row than moving the row: a
    table of under ``SPREAD_BELOW_BYTES`` is then dealt out to all cores. Of a
    larger one Spark's own splits are kept, without a shuffle.
    """
    df = spark.read.parquet(path)
    if spread:
        size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        if size < SPREAD_BELOW_BYTES:
            df = df.repartition(spark.sparkContext.defaultParallelism)
    return df


def write_parquet(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    sort_within: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> None:
    """Write parquet whose timestamp columns have min/max per row group.

    ``sort_within`` orders rows inside each output file, so that the row groups
    of a file cover disjoint ranges and a reader can skip most of them. It
    needs no shuffle and is indifferent to hot values.
    """
    if sort_within:
        df = df.sortWithinPartitions(*partition_by, *sort_within)
    with session_conf(df.sparkSession, PARQUET_TIMESTAMP_SETTINGS):
        df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_whole_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Each file in full as one row (``path``, ``content``).

    Partition folders (``key=value``) under a single root also become columns.
    """
    content = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    extra = [name for name in content.columns if name != "value"]
    return content.select(
        F.input_file_name().alias("path"), F.col("value").alias("content"), *extra
    )


# Fixed value: the line that ends a document in a file of several.
DOCUMENT_END = "---"


def write_documents(df: DataFrame, column: str, path: str, per_file: int = 10_000) -> None:
    """Write the texts of ``column`` to text files of at most ``per_file`` documents each.

    The number of files follows from the splits of ``df`` and that bound, not
    from the number of documents. A text must not hold a line of its own that
    ends a document; one that does fails the job.
    """
    text = F.col(column)
    ends_early = text.rlike(rf"(?m)^{DOCUMENT_END}$")
    whole = F.concat(text, F.lit(f"\n{DOCUMENT_END}"))
    refused = F.raise_error(F.lit(f"a document holds a line {DOCUMENT_END}"))
    df.select(F.when(ends_early, refused).otherwise(whole).alias("value")).where(
        F.col("value").isNotNull()
    ).write.option("maxRecordsPerFile", per_file).text(path)


def split_documents(files: DataFrame) -> DataFrame:
    """Each document of whole files (``path``, ``content``) as a row of its own."""
    documents = F.split("content", rf"(?m)^{DOCUMENT_END}$\n?")
    return files.withColumn("content", F.explode(documents)).where("content <> ''")
