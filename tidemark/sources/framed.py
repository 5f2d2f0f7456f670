"""Whole texts in framed files: each comes back byte for byte, null or empty ones too.

A frame is the lengths of a row's key and content and then their bytes, so no
character ends a text. Each task writes one file and says where about every
``BLOCK_BYTES`` of it a frame begins; the index that names files and places is
written last, by the driver. Only files in an index count, so what a lost or
repeated task left behind is never read. Reads are planned from the index: a
partition is a range of bytes, however long or short the texts are.
"""

from __future__ import annotations

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

FORMAT = "tidemark_framed"
# A read task's bytes, or one longer frame; and what a task hands to Spark at once.
BLOCK_BYTES = 32 << 20
BATCH_BYTES = 4 << 20


def write_framed(
    df: DataFrame, content: str, path: str, key: str | None = None, mode: str = "append"
) -> None:
    """Write the texts of ``content`` to framed files under ``path``, with ``key`` beside them.

    Nulls stay null and empty texts empty, and no text is changed or refused. A
    repeated call adds to what is there; ``mode="overwrite"`` replaces it. The
    work takes no shuffle; one file a task, in which rows keep their order.
    """
    df.sparkSession.dataSource.register(_source(BLOCK_BYTES, BATCH_BYTES))
    name = F.lit(None) if key is None else F.col(key)
    df.select(name.cast("string").alias("key"), F.col(content).cast("string").alias("content")).write.format(
        FORMAT).option("uri", uri_of(df.sparkSession, path)).mode(mode).save()


def read_framed(spark: SparkSession, path: str) -> DataFrame:
    """All texts written to ``path`` so far: ``key`` and ``content``, in no order."""
    spark.dataSource.register(_source(BLOCK_BYTES, BATCH_BYTES))
    return spark.read.format(FORMAT).option("uri", uri_of(spark, path)).load()


def uri_of(spark: SparkSession, path: str) -> str:
    """``path`` in full, escaped as Arrow's file systems take it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(found).toUri().toString()


def _source(block_bytes: int, batch_bytes: int) -> type[DataSource]:
    # Nested classes travel by value, so workers need only pyspark and pyarrow.
    def opened(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
        import pyarrow.fs

        return pyarrow.fs.FileSystem.from_uri(uri)

    class Written(WriterCommitMessage):
        def __init__(self, name: str, places: list[int]) -> None:
            self.name, self.places = name, places

    class Writer(DataSourceArrowWriter):
        def __init__(self, uri: str, overwrite: bool) -> None:
            self.uri, self.overwrite = uri, overwrite

        def write(self, iterator):
            import struct
            import uuid

            import pyarrow as pa

            name = f"{uuid.uuid4().hex}.frames"
            system, path = opened(self.uri)
            system.create_dir(path, recursive=True)
            places, size = [], 0
            with system.open_output_stream(f"{path}/{name}") as out:
                for batch in iterator:
                    keys, texts = (one.cast(pa.large_binary()) for one in batch.columns)
                    for at in range(batch.num_rows):
                        if not places or size - places[-1] >= block_bytes:
                            places.append(size)
                        key, text = keys[at], texts[at]
                        parts = [one.as_buffer() if one.is_valid else None for one in (key, text)]
                        lengths = [-1 if one is None else one.size for one in parts]
                        out.write(struct.pack("<qq", *lengths))
                        size += 16
                        for one in parts:
                            if one is not None and one.size:
                                out.write(one)
                                size += one.size
            return Written(name, [*places, size])

        def commit(self, messages):
            import json
            import uuid

            import pyarrow.fs

            system, path = opened(self.uri)
            system.create_dir(f"{path}/index", recursive=True)
            before = [one.path for one in system.get_file_info(pyarrow.fs.FileSelector(f"{path}/index"))]
            done = [[one.name, one.places] for one in messages if one is not None and len(one.places) > 1]
            with system.open_output_stream(f"{path}/index/{uuid.uuid4().hex}.json") as out:
                out.write(json.dumps(done).encode())
            for old in before if self.overwrite else ():
                self.remove(system, path, old)

        @staticmethod
        def remove(system, path: str, index: str) -> None:
            import json

            with system.open_input_stream(index) as held:
                names = [name for name, _ in json.loads(held.read())]
            # The index goes first: readers then miss the old texts, and find no broken ones.
            system.delete_file(index)
            for name in names:
                system.delete_file(f"{path}/{name}")

        def abort(self, messages):
            system, path = opened(self.uri)
            for one in messages:
                if one is not None:
                    system.delete_file(f"{path}/{one.name}")

    class Reader(DataSourceReader):
        def __init__(self, uri: str, schema: StructType) -> None:
            self.uri, self.schema = uri, schema

        def partitions(self):
            import json

            import pyarrow.fs

            system, path = opened(self.uri)
            found = []
            for index in system.get_file_info(pyarrow.fs.FileSelector(f"{path}/index")):
                with system.open_input_stream(index.path) as held:
                    for name, places in json.loads(held.read()):
                        found += [InputPartition((name, low, high)) for low, high in zip(places, places[1:])]
            return found or [InputPartition(None)]

        def read(self, partition):
            import struct

            import pyarrow as pa

            if partition.value is None:
                return
            name, at, stop = partition.value
            system, path = opened(self.uri)
            rows, size = [], 0
            fields = [pa.field("key", pa.string()), pa.field("content", pa.string())]

            def batch():
                return pa.RecordBatch.from_arrays(
                    [pa.array(values, pa.binary()).cast(pa.string()) for values in zip(*rows)],
                    schema=pa.schema(fields))

            with system.open_input_file(f"{path}/{name}") as held:
                held.seek(at)
                while at < stop:
                    lengths = struct.unpack("<qq", held.read(16))
                    row = tuple(None if one < 0 else held.read(one) for one in lengths)
                    own = sum(max(one, 0) for one in lengths)
                    at += 16 + own
                    if rows and size + own > batch_bytes:
                        yield batch()
                        rows, size = [], 0
                    rows.append(row)
                    size += own
            if rows:
                yield batch()

    class Framed(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tidemark_framed"

        def schema(self) -> str:
            return "key string, content string"

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(self.options["uri"], schema)

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
            return Writer(self.options["uri"], overwrite)

    return Framed
