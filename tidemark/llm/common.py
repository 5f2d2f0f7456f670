"""What the operators share: words of raw bytes, Arrow columns, tables kept in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

# Byte tables. Every byte of a non-ASCII character is 0x80 or more, so both word
# rules can be applied to UTF-8 without decoding it.
_LOWER = bytes(range(65, 91))
_ALNUM = bytes(
    byte + 32 if byte in _LOWER
    else byte if byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A
    else 0x20
    for byte in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters; A-Z become a-z."""
    return text.translate(_ALNUM).split()


def alnum_mask(text: bytes) -> bytes:
    """``text`` with A-Z in lower case and a space for every byte outside a word."""
    return text.translate(_ALNUM)


def spaced_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space; A-Z become a-z."""
    return text.lower().split()


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Just ``id`` (long) and ``text``, so that no other column can clash."""
    return df.select(column(id_column).cast("long").alias("id"),
                     column(text_column).cast("string").alias("text"))


def as_bytes(values: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is empty."""
    return [value or b"" for value in values.cast(pa.large_binary()).to_pylist()]


def numbered_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct runs between ASCII white space, the number of each in turn, and where each text's end."""
    words, numbers, ends = numbered(texts)
    return as_list(words), numbers, ends


def numbered(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """``numbered_words`` with the runs as an Arrow array."""
    texts = [text.strip() for text in texts]
    split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    offsets = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    numbers, counts = coded.indices.to_numpy(), np.diff(offsets)
    # An empty text gives one empty run.
    blank = np.flatnonzero(np.fromiter(map(len, texts), np.int64, len(texts)) == 0)
    blank = blank[counts[blank] > 0]
    if blank.size:
        numbers = np.delete(numbers, offsets[blank])
        counts[blank] = 0
    return coded.dictionary.cast(pa.large_binary()), numbers, np.cumsum(counts)


def laid_out(values: pa.LargeBinaryArray) -> tuple[pa.Buffer, np.ndarray]:
    """The bytes of an array without nulls, and where in them each value starts and the last ends."""
    _, ends, data = values.buffers()
    if not len(values) or data is None:
        return pa.py_buffer(b""), np.zeros(len(values) + 1, np.int64)
    return data, np.frombuffer(ends, np.int64)[values.offset:values.offset + len(values) + 1]


def as_list(values: pa.LargeBinaryArray) -> list[bytes]:
    """``to_pylist`` of an array without nulls, cut from one copy."""
    data, ends = laid_out(values)
    data, cuts = data.to_pybytes(), ends.tolist()
    return [data[i:j] for i, j in zip(cuts, cuts[1:])]


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """The id column and the texts as bytes of each batch that has rows."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column("id"), as_bytes(batch.column("text"))


def slices(batch: pa.RecordBatch, size: int, text: str = "text") -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts hold about ``size`` bytes, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(False))
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the cluster's shared folder, and read back.

    This cuts the lineage: what follows survives the loss of any executor
    without running the work before it again.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remainder(id_column: Column, divisor: int) -> Column:
    """``crc32(id as text) mod divisor``; a null id counts as the empty text."""
    text = F.coalesce(id_column.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor)).cast("int")
