"""Benchmark decontamination: one Aho-Corasick automaton over the items' windows of words.

The automaton's letters are word numbers, so a match starts and ends at words by
construction. A document is scanned once; matches give word positions, which are
mapped back to byte offsets of the original text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import alnum_mask, alnum_words, as_bytes, id_and_text, slices, texts

WINDOW = 10
MAX_BENCHMARK_BYTES = 64 * 1024 * 1024
TEXT_BYTES = 4 << 20
SCHEMA = (
    "id long, n_words long, n_hit long, item_ids array<long>, "
    "spans array<struct<start: long, end: long>>"
)
_WINDOWS = "item long, words array<binary>"


class Matcher(NamedTuple):
    """The automaton, the number of each of its words, and each window's length and items."""

    automaton: ahocorasick.Automaton
    numbers: dict[bytes, int]
    lengths: list[int]
    items: list[tuple[int, ...]]


def item_windows(benchmark: DataFrame, window: int, id_column: str, text_column: str) -> DataFrame:
    """Every run of ``window`` words of an item; all its words if it has fewer, but some."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in texts(batches):
            found = [
                (item, words[at:at + window])
                for item, words in zip(ids.to_pylist(), map(alnum_words, rows)) if words
                for at in range(max(1, len(words) - window + 1))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([item for item, _ in found], pa.int64()),
                 pa.array([words for _, words in found], pa.list_(pa.binary()))],
                names=["item", "words"])

    return id_and_text(benchmark, id_column, text_column).mapInArrow(cut, _WINDOWS)


def build_matcher(windows: list[tuple[tuple[bytes, ...], tuple[int, ...]]]) -> Matcher:
    """The automaton over (words, items); 0 is the number of every other word."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    numbers: dict[bytes, int] = {}
    for at, (words, _) in enumerate(windows):
        key = tuple(numbers.setdefault(word, len(numbers) + 1) for word in words)
        automaton.add_word(key, at)
    if windows:
        automaton.make_automaton()
    return Matcher(automaton, numbers, [len(words) for words, _ in windows],
                   [items for _, items in windows])


def scan(matcher: Matcher, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged (start, end) word spans of all occurrences, and the items they are of."""
    if not matcher.lengths or not words:
        return [], set()
    number = matcher.numbers.get
    spans: list[tuple[int, int]] = []
    found: set[int] = set()
    for last, window in matcher.automaton.iter(tuple(number(word, 0) for word in words)):
        found.add(window)
        start, end = last + 1 - matcher.lengths[window], last + 1
        # Ends come in order, so a span can only grow into the ones before it.
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))
    return spans, {item for window in found for item in matcher.items[window]}


def byte_offsets(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Where the word spans lie in the UTF-8 of the original text."""
    if not spans:
        return []
    inside = np.frombuffer(alnum_mask(text), np.uint8) != 0x20
    edges = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [{"start": int(starts[first]), "end": int(ends[last - 1])} for first, last in spans]


_MATCHERS: dict[bytes, Matcher] = {}


def _matcher(key: bytes, windows: list) -> Matcher:
    """One automaton per worker process and benchmark."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = build_matcher(windows)
    return _MATCHERS[key]


def _shared_windows(
    docs: DataFrame, benchmark: DataFrame, item_column: str, text_column: str, window: int
) -> Broadcast:
    """The benchmark's windows with their items, broadcast after their size was checked."""
    windows = item_windows(benchmark, window, item_column, text_column)
    size = F.aggregate("words", F.lit(0).cast("long"), lambda total, one: total + F.length(one) + 1)
    total = windows.agg(F.sum(size + 16).alias("bytes")).first()["bytes"] or 0
    if total > MAX_BENCHMARK_BYTES:
        raise ValueError(f"the benchmark's windows hold {total} bytes; pass it in parts")
    gathered = windows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    plain = sorted(
        (tuple(bytes(word) for word in row["words"]), tuple(row["items"]))
        for row in gathered.collect()
    )
    key = hashlib.sha256(repr(plain).encode()).digest()
    return docs.sparkSession.sparkContext.broadcast((key, plain))


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """``docs`` with all its columns, without the rows in which a window occurs.

    Rows are judged as ``find_contamination`` does, where they are read: nothing
    is joined or shuffled.
    """
    shared = _shared_windows(docs, benchmark, item_column, item_text_column, window)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(*shared.value)
        for batch in batches:
            for part in slices(batch, TEXT_BYTES, text_column):
                yield part.filter(pa.array([
                    not scan(matcher, alnum_words(text))[0]
                    for text in as_bytes(part.column(text_column))
                ], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document row: words, hit words, items found, and byte spans of the hits.

    Null, empty and wordless texts have no words and no hits; so has everything
    against an empty benchmark, or against items that are null or wordless. A
    window of several items counts for each of them; a repeated item counts
    once; a null item id counts its hits but names no item. Texts of any length
    are scanned whole; repeated rows each give a row. Only the named columns are
    read, so other columns cannot clash. The windows are gathered for the
    automaton only after their size has been summed on the cluster; over
    ``MAX_BENCHMARK_BYTES`` they are refused, and the caller has to pass the
    benchmark in parts.
    """
    shared = _shared_windows(docs, benchmark, item_column, item_text_column, window)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(*shared.value)
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                counts, hits, items, places = [], [], [], []
                for text in as_bytes(part.column("text")):
                    words = alnum_words(text)
                    spans, found = scan(matcher, words)
                    counts.append(len(words))
                    hits.append(sum(end - start for start, end in spans))
                    items.append(sorted(found))
                    places.append(byte_offsets(text, spans))
                yield pa.RecordBatch.from_arrays([
                    part.column("id"),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.int64()),
                    pa.array(items, pa.list_(pa.int64())),
                    pa.array(places, pa.list_(pa.struct([("start", pa.int64()),
                                                         ("end", pa.int64())]))),
                ], names=["id", "n_words", "n_hit", "item_ids", "spans"])

    return id_and_text(docs, id_column, text_column).mapInArrow(scanned, SCHEMA)
