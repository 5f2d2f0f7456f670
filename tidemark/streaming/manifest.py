"""Streams that follow a manifest: bounded batches in event time, of many files each.

A table is laid out once by ranges of time, the ranges from sampled quantiles. A
manifest names the files of each batch, and a stream source follows it, one
batch a trigger. No file's time is read or set, so it works on any store that
both Spark and Arrow's file systems reach.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructField, StructType

from tidemark.session import fresh_name
from tidemark.sources.files import write_parquet
from tidemark.sources.framed import uri_of

SOURCE = "tidemark_manifest"
MICROS = 1_000_000
# Errors of a sampled quantile, in ranks: batches are about equal, never exactly.
QUANTILE_ACCURACY = 10_000


class Layout(NamedTuple):
    """Where a manifest is, how many batches a stream over it has, and its rows."""

    path: str
    batches: int
    rows: int


def _write(uri: str, value: object) -> None:
    system, path = pyarrow.fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(json.dumps(value).encode())


def lay_out(
    df: DataFrame,
    time: str,
    path: str,
    batches: int = 1,
    cuts: Sequence[int] | None = None,
    closing: int | None = None,
) -> Layout:
    """Write ``df`` under ``path`` as about ``batches`` batches that follow each other in ``time``.

    ``cuts`` (microseconds) are where batches begin; without them, sampled
    quantiles of the time are taken, which are distinct, so there may be fewer
    batches. Rows of one time are of one batch; those without a time are of the
    first. Adaptive execution cuts each batch into files by their size, so a
    batch has as many tasks as its data needs, and a time that many rows share
    is no single task's.

    With ``closing`` (seconds), a last batch has one row of nulls, that far after
    the latest time: it lets the watermark pass all that came before, so that a
    bounded table is answered to its end.
    """
    spark = df.sparkSession
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    shares = [number / batches for number in range(1, batches)] if cuts is None else []
    found = df.agg(
        F.max(micros).alias("last"), F.count(F.lit(1)).alias("rows"),
        (F.percentile_approx(micros, shares, QUANTILE_ACCURACY) if shares else F.lit(None)).alias("cuts"),
    ).first()
    steps = sorted(set(cuts if cuts is not None else found["cuts"] or []))
    batch = fresh_name("batch")
    number = F.size(F.filter(F.array(*map(F.lit, steps)), lambda cut: cut <= micros)) if steps else F.lit(0)
    dealt = df.withColumn(batch, F.when(micros.isNull(), 0).otherwise(number)).hint("rebalance", batch)
    write_parquet(dealt, path, sort_within=[time], partition_by=[batch])
    uri = uri_of(spark, f"{path}-manifest")
    files: dict[int, list[str]] = {}
    for name in spark.read.schema(df.schema).parquet(path).inputFiles():
        files.setdefault(int(re.search(rf"/{batch}=(\d+)/", name).group(1)), []).append(name)
    lists: list[list] = [sorted(files[number]) for number in sorted(files)]
    if closing is not None and found["last"] is not None:
        lists.append([[time, found["last"] + closing * MICROS]])
    for number, names in enumerate(lists):
        _write(f"{uri}/{number}.json", names)
    # The closing row has nulls in columns that otherwise have none.
    schema = StructType([StructField(one.name, one.dataType, True, one.metadata) for one in df.schema])
    _write(f"{uri}/all.json", {"batches": len(lists), "schema": schema.json()})
    return Layout(uri, len(lists), found["rows"])


def stream_manifest(
    spark: SparkSession, layout: Layout, columns: Sequence[str] | None = None, position: str | None = None
) -> DataFrame:
    """A stream over a layout, one of its batches a trigger; only ``columns`` are read.

    ``position`` is a file, one for each checkpoint, in which the stream notes how
    far it has come; a restart from the checkpoint needs it. Run it with
    ``run_stream(..., batches=layout.batches)``: all that is available at once
    would be one single batch.
    """
    spark.dataSource.register(_source())
    reader = spark.readStream.format(SOURCE).option("manifest", layout.path)
    if columns is not None:
        reader = reader.option("columns", json.dumps(list(columns)))
    if position is not None:
        reader = reader.option("position", uri_of(spark, position))
    return reader.load()


def _source() -> type[DataSource]:
    # Nested classes travel by value, so workers need only pyspark and pyarrow.
    def read_json(uri: str) -> object:
        import json

        import pyarrow.fs

        system, path = pyarrow.fs.FileSystem.from_uri(uri)
        with system.open_input_stream(path) as held:
            return json.loads(held.read())

    class Reader(DataSourceStreamReader):
        """Batch n of the manifest is what lies between the offsets n and n + 1."""

        def __init__(self, options: dict, schema: StructType) -> None:
            self.manifest, self.position = options["manifest"], options.get("position")
            self.schema = schema
            self.total = read_json(f"{self.manifest}/all.json")["batches"]
            self.at = 0
            if self.position:
                try:
                    self.at = read_json(self.position)["batch"]
                except FileNotFoundError:
                    pass

        def initialOffset(self) -> dict:
            return {"batch": 0}

        def latestOffset(self) -> dict:
            self.at = min(self.at + 1, self.total)
            return {"batch": self.at}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            self.at = max(self.at, end["batch"])
            return [InputPartition(one) for number in range(start["batch"], end["batch"])
                    for one in read_json(f"{self.manifest}/{number}.json")]

        def commit(self, end: dict) -> None:
            import json

            import pyarrow.fs

            if self.position:
                system, path = pyarrow.fs.FileSystem.from_uri(self.position)
                with system.open_output_stream(path) as out:
                    out.write(json.dumps(end).encode())

        def read(self, partition: InputPartition):
            import pyarrow as pa
            import pyarrow.fs
            import pyarrow.parquet
            from pyspark.sql.pandas.types import to_arrow_schema

            target = to_arrow_schema(self.schema)
            if isinstance(partition.value, list):
                time, micros = partition.value
                yield pa.RecordBatch.from_arrays(
                    [pa.array([micros if one.name == time else None], pa.int64()).cast(one.type)
                     if one.name == time else pa.nulls(1, one.type) for one in target], schema=target)
                return
            system, path = pyarrow.fs.FileSystem.from_uri(partition.value)
            with system.open_input_file(path) as held:
                file = pyarrow.parquet.ParquetFile(held)
                for batch in file.iter_batches(columns=target.names, batch_size=1 << 16):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(one.name).cast(one.type) for one in target], schema=target)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_manifest"

        def schema(self) -> StructType:
            import json

            whole = StructType.fromJson(json.loads(read_json(f"{self.options['manifest']}/all.json")["schema"]))
            names = json.loads(self.options.get("columns", "null"))
            return whole if names is None else StructType([whole[name] for name in names])

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return Reader(self.options, schema)

    return Source
