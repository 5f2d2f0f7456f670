"""Token counts: a scan for end-of-document ids in flat token files that have no index.

The files hold 16-bit ids and nothing else. They are cut in blocks of a fixed
number of ids; each block is searched on its own by one vectorised comparison,
and reports the ends it holds. A prefix scan over a file's blocks then carries
the end of the last document into the blocks after it, which gives each
document's start, however many blocks it runs through.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.byte_bpe import read_ranks
from tidemark.llm.common import id_and_text, slices
from tidemark.session import scratch_path

BLOCK_IDS = 1 << 18
TAIL_IDS = 24
TEXT_BYTES = 4 << 20
ROWS_PER_FILE = 20_000
_NAME_LETTERS = "\n-0123456789"
_BLOCKS = (
    "file string, block long, ends array<long>, closed array<boolean>, tails array<array<int>>"
)


def write_token_files(
    docs: DataFrame,
    path: str,
    ranks: Mapping[bytes, int],
    pattern: str,
    separator: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Write every row's ids, then its name, then ``separator``, to flat files under ``path``.

    The name is a line break and the row's id, a token for each character, so
    the files say which document is whose without an index; a null id is spelt
    as nothing. Spark's text sink writes the bytes, with the separator's two bytes
    between rows, so files go to any store that Spark can write.
    """
    if not 0 < separator < 1 << 16 or max(ranks.values()) >= 1 << 16 or separator in ranks.values():
        raise ValueError("ids of 16 bits and a free separator are needed")
    shared = docs.sparkSession.sparkContext.broadcast(dict(ranks))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        letter = {one: shared.value[one.encode()] for one in _NAME_LETTERS}
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                rows = [
                    encoding.encode_to_numpy(text or "", disallowed_special=()).astype("<u2").tobytes()
                    + np.array([letter[one] for one in f"\n{'' if ident is None else ident}"],
                               "<u2").tobytes()
                    for ident, text in zip(part.column("id").to_pylist(),
                                           part.column("text").to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["ids"])

    (
        id_and_text(docs, id_column, text_column).mapInArrow(encoded, "ids binary")
        .select(F.col("ids").cast("string").alias("value"))
        .write.option("lineSep", separator.to_bytes(2, "little").decode("latin-1"))
        .option("encoding", "ISO-8859-1").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)
    )


def scan_block(ids: np.ndarray, start: int, stop: int, separator: int) -> np.ndarray:
    """Places of ``separator`` in one block of a file's ids."""
    return start + np.flatnonzero(ids[start:stop] == separator)


def scan_token_files(spark: SparkSession, path: str, separator: int) -> DataFrame:
    """One row per document of the files under ``path``.

    ``file``, ``ordinal`` (from 0 in its file), ``start`` and ``n_ids`` (without
    the separator), ``closed`` (a separator ends it; false for ids after a file's
    last one) and ``tail`` (its last ids, at most ``TAIL_IDS``). An empty document
    has no ids; an empty file has no documents. A file whose bytes are not whole
    ids is refused.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                raw = content.as_buffer()
                if raw.size % 2:
                    raise ValueError(f"{name} holds {raw.size} bytes, which are not ids of two")
                ids = np.frombuffer(raw, "<u2")
                for start in range(0, len(ids), BLOCK_IDS):
                    stop = min(start + BLOCK_IDS, len(ids))
                    ends = scan_block(ids, start, stop, separator)
                    closed = np.ones(len(ends), bool)
                    if stop == len(ids) and ids[-1] != separator:
                        ends, closed = np.append(ends, stop), np.append(closed, False)
                    # Ids before an end are read from the file, also across the block's edge.
                    tails = [_tail(ids, end, separator) for end in ends.tolist()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name]), pa.array([start // BLOCK_IDS], pa.int64()),
                        pa.array([ends], pa.list_(pa.int64())),
                        pa.array([closed], pa.list_(pa.bool_())),
                        pa.array([tails], pa.list_(pa.list_(pa.int32()))),
                    ], names=["file", "block", "ends", "closed", "tails"])

    blocks = files.mapInArrow(searched, _BLOCKS)
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    stitched = (
        blocks.withColumn("carried", F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before) + 1, F.lit(0)))
        .withColumn("counted", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    )
    ends = stitched.select(
        "file", "counted", "carried", "ends",
        F.posexplode(F.arrays_zip(F.col("ends").alias("end"), "closed", F.col("tails").alias("tail"))))
    start = F.when(F.col("pos") == 0, F.col("carried")).otherwise(F.try_element_at("ends", F.col("pos")) + 1)
    return ends.select(
        "file", (F.col("counted") + F.col("pos")).alias("ordinal"), start.alias("start"),
        (F.col("col.end") - start).alias("n_ids"), F.col("col.closed").alias("closed"),
        F.col("col.tail").alias("tail"))


def _tail(ids: np.ndarray, end: int, separator: int) -> np.ndarray:
    own = ids[max(0, end - TAIL_IDS):end]
    other = np.flatnonzero(own == separator)
    return (own[other[-1] + 1:] if other.size else own).astype(np.int32)


def count_tokens(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    separator: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id`` and ``n_tokens`` of each row, counted in files that are written for it.

    A null or empty text has no tokens. Texts of any length are written and
    counted whole; repeated rows, and rows without an id, each give a row; an
    empty table gives an empty result. Only the two named columns are read.
    """
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    path = scratch_path(spark, "token-ids")
    write_token_files(docs, path, ranks, pattern, separator, id_column, text_column)
    found = scan_token_files(spark, path, separator)
    newline = ranks[b"\n"]
    # The name follows the last line break of the tail; its tokens hold none.
    turned = F.reverse("tail")
    named = F.array_position(turned, F.lit(newline).cast("int"))
    digits = F.reverse(F.slice(turned, F.lit(1), (named - 1).cast("int")))
    names = F.create_map(*(
        F.lit(one) for letter in _NAME_LETTERS for one in (ranks[letter.encode()], letter)))
    ident = F.array_join(F.transform(digits, lambda one: names[one]), "")
    return found.select(
        F.when(named > 1, ident).cast("long").alias("id"), (F.col("n_ids") - named).alias("n_tokens"))
