"""Periodic runs of words: recursive frequency splitting, then lag scans of what survives.

A run is a longest stretch of words that repeat at a distance, its smallest
period q, over at least three periods and ``least`` words. Each of its words
occurs three times or more within it. So a word that occurs less often in its
segment stands in no run there, and splits the segment; the parts are counted
anew, until no word is too rare. What survives is scanned for equal words at
each lag. Lags of ``SHORT`` and more are scanned only where a window of 2^k words
comes again 2^k to 2^(k+1) words on, as a run with such a period shows at one
of every 2^k places: all lags together then cost O(n log n) for n words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import as_bytes, id_and_text, slices

LEAST_WORDS = 24
LEAST_PERIODS = 3
# Lags below this are compared over whole segments; a power of two.
SHORT = 32
TEXT_BYTES = 4 << 20
SCHEMA = (
    "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
    "collapsed string"
)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of several texts: numbers, places in the joined bytes, and text of each."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        blank = _BLANK[self.data]
        steps = np.diff(blank.view(np.int8), prepend=np.int8(1))
        self.starts, self.stops = np.flatnonzero(steps == -1), np.flatnonzero(steps == 1)
        text_starts = np.cumsum([0] + [len(text) + 1 for text in texts])
        self.firsts = np.searchsorted(self.starts, text_starts)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.firsts))
        offsets = np.concatenate(([0], np.cumsum(self.stops - self.starts)))
        distinct = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), self.starts.size,
            [None, pa.py_buffer(offsets), pa.py_buffer(self.data[~blank])]).dictionary_encode()
        self.numbers = distinct.indices.to_numpy(False).astype(np.int64)
        self.n_numbers = len(distinct.dictionary)

    def joined(self, kept: np.ndarray) -> pa.Array:
        """The texts of the kept words, joined by one blank."""
        out = np.where(_BLANK[self.data], np.uint8(0x20), self.data)
        taken = np.zeros(out.size, bool)
        inside = ~_BLANK[self.data]
        taken[inside] = np.repeat(kept, self.stops - self.starts)
        # Each kept word brings the blank after it, but for the last of a text.
        places, of = np.flatnonzero(kept), self.text[kept]
        follows = np.append(of[1:] == of[:-1], False) if places.size else np.zeros(0, bool)
        taken[self.stops[places[follows]]] = True
        ends = np.concatenate(([0], np.cumsum(taken)))
        bounds = ends[np.append(self.starts, out.size)[self.firsts]]
        return pa.LargeStringArray.from_buffers(
            self.firsts.size - 1, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[taken]))


def surviving(numbers: np.ndarray, texts: np.ndarray, n_numbers: int, least: int) -> np.ndarray:
    """(start, stop) of the segments in which no word is too rare, of ``least`` words or more."""
    at, segment = np.arange(numbers.size), texts
    found = [np.zeros((0, 2), np.int64)]
    while at.size:
        keys, inverse, counts = np.unique(
            segment * n_numbers + numbers[at], return_inverse=True, return_counts=True)
        rare = counts[inverse] < LEAST_PERIODS
        split = (np.bincount(segment, rare) > 0)[segment]
        first = np.append(True, segment[1:] != segment[:-1])
        last = np.append(first[1:], True)
        # On the first turn segments are whole texts, which may be too short themselves.
        found.append(np.column_stack((at[first & ~split], at[last & ~split] + 1)))
        left = split & ~rare
        at, segment = at[left], segment[left]
        if at.size:
            segment = np.cumsum(np.append(
                False, (np.diff(at) != 1) | (segment[1:] != segment[:-1])))
            long = (np.bincount(segment) >= least)[segment]
            at, segment = at[long], segment[long]
    segments = np.concatenate(found)
    return segments[segments[:, 1] - segments[:, 0] >= least]


class _Laid:
    """Segments laid one after another, each followed by a number that stands nowhere else.

    No stretch of equal words at a lag can pass such a number by more than the
    lag, which is less than a run needs.
    """

    def __init__(self, numbers: np.ndarray, segments: np.ndarray) -> None:
        sizes = segments[:, 1] - segments[:, 0] + 1
        self.ends = np.cumsum(sizes)
        self.shift = segments[:, 0] - (self.ends - sizes)
        self.places = np.arange(self.ends[-1]) + np.repeat(self.shift, sizes)
        self.values = numbers[np.minimum(self.places, numbers.size - 1)]
        self.values[self.ends - 1] = -1 - np.arange(self.ends.size)

    def source(self, place: np.ndarray) -> np.ndarray:
        """Where laid places stand among all words."""
        return place + self.shift[np.searchsorted(self.ends, place, "right")]


def _short_lags(numbers: np.ndarray, segments: np.ndarray, least: int) -> list[np.ndarray]:
    """Rows (start, stop, lag) of all stretches at lags below ``SHORT``, long enough for a run."""
    laid = _Laid(numbers, segments)
    values, found = laid.values, []
    for lag in range(1, min(SHORT, values.size)):
        differ = np.flatnonzero(values[:-lag] != values[lag:])
        before = np.concatenate(([-1], differ))
        after = np.append(differ, values.size - lag)
        long = after - before - 1 >= max(least, LEAST_PERIODS * lag) - lag
        if long.any():
            start = before[long] + 1
            size = after[long] - start + lag
            source = laid.source(start)
            found.append(np.column_stack((source, source + size, np.full(size.size, lag))))
    return found


def _reach(values: np.ndarray, one: int, two: int, step: int) -> int:
    """How many words from ``one`` and ``two`` on are equal, going by ``step`` (1 or -1)."""
    size, done = 64, 0
    while True:
        room = min(size, values.size - two if step > 0 else one + 1)
        if room <= 0:
            return done
        a = values[one:one + room] if step > 0 else values[one - room + 1:one + 1][::-1]
        b = values[two:two + room] if step > 0 else values[two - room + 1:two + 1][::-1]
        differ = a != b
        at = int(differ.argmax())
        if differ[at]:
            return done + at
        done, one, two, size = done + room, one + step * room, two + step * room, 2 * size


def _long_lags(
    numbers: np.ndarray, segments: np.ndarray, known: list[np.ndarray], least: int
) -> list[np.ndarray]:
    """Rows (start, stop, lag) of stretches at lags of ``SHORT`` and more, lags rising by octaves."""
    found: list[np.ndarray] = []
    size = SHORT
    segments = segments[segments[:, 1] - segments[:, 0] >= LEAST_PERIODS * size]
    if not segments.size:
        return found
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, int(numbers.max()) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    while segments.size:
        laid = _Laid(numbers, segments)
        values = laid.values
        window = hashes[np.maximum(values, 0)]
        window[laid.ends - 1] = rng.integers(0, 1 << 63, laid.ends.size, np.uint64)
        width, base = 1, np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            while width < size:
                window = window[:-width] * base + window[width:]
                width, base = 2 * width, base * base + np.uint64(width << 1)
        # Windows that would pass the end are filled up with numbers of their own.
        blocks = np.concatenate((
            window, rng.integers(0, 1 << 63, -window.size % size, np.uint64))).reshape(-1, size)
        block, off = np.nonzero(blocks[1:] == blocks[:-1, :1])
        place, lag = block * size, size + off
        # What lies within a run of a period up to the window's width has no other period.
        covered = np.zeros(len(blocks), np.int64)
        sources = laid.source(np.arange(len(blocks)) * size)
        order = np.argsort(sources, kind="stable")
        rising = sources[order]
        for row in known + found:
            hides = (row[:, 2] <= size) & (row[:, 1] - row[:, 0] >= 2 * size)
            for start, stop, _ in row[hides].tolist():
                inside = order[np.searchsorted(rising, start):np.searchsorted(rising, stop)]
                covered[inside] = np.maximum(covered[inside], stop)
        free = sources[block] + size + lag > covered[block]
        place, lag = place[free], lag[free]
        rows, done = [], {}
        for at, by in sorted(zip(place.tolist(), lag.tolist())):
            if at < done.get(by, 0):
                continue
            ahead = _reach(values, at, at + by, 1)
            behind = _reach(values, at - 1, at - 1 + by, -1)
            done[by] = at + ahead
            length = behind + ahead + by
            if length >= max(least, LEAST_PERIODS * by):
                start = int(laid.source(np.array([at - behind]))[0])
                rows.append((start, start + length, by))
        if rows:
            found.append(np.array(rows))
        size *= 2
        segments = segments[segments[:, 1] - segments[:, 0] >= LEAST_PERIODS * size]
    return found


def runs_of(words: Words, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows (start, stop, period) of all runs, by start and then period."""
    segments = surviving(words.numbers, words.text, words.n_numbers, least)
    if not segments.size:
        return np.zeros((0, 3), np.int64)
    found = _short_lags(words.numbers, segments, least)
    found += _long_lags(words.numbers, segments, found, least)
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.concatenate(found)
    # A stretch that keeps a period keeps its multiples: the smallest is the run's.
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _found(ids: pa.Array, texts: list[bytes], least: int) -> pa.RecordBatch:
    words = Words(texts)
    rows = runs_of(words, least)
    # Words after a run's first period are dropped: steps up and down, summed.
    steps = np.zeros(words.numbers.size + 1, np.int64)
    np.add.at(steps, rows[:, 0] + rows[:, 2], 1)
    np.add.at(steps, rows[:, 1], -1)
    kept = np.cumsum(steps)[:-1] == 0
    own = words.text[rows[:, 0]]
    fields = [rows[:, 0] - words.firsts[own], rows[:, 1] - rows[:, 0], rows[:, 2]]
    bounds = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(
        pa.array(bounds), pa.StructArray.from_arrays([pa.array(one) for one in fields], fields=list(_RUN)))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(words.firsts)), runs, words.joined(kept).cast(pa.string())],
        names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = LEAST_WORDS,
) -> DataFrame:
    """One row per input row: ``id``, ``n_words``, its ``runs``, and the text ``collapsed``.

    Words stand between ASCII white space and are compared byte by byte. A run
    (start, length, period; words from 0) is a stretch whose words repeat at
    ``period``, the smallest such distance, over three periods and ``least``
    words at least, and that no neighbouring word extends. Runs may overlap; they
    are sorted by start, then period. ``collapsed`` has the words that no run
    holds after its first period, joined by one blank.

    Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Texts are read whole, of any length that fits a task: the
    memory is some 30 bytes for each byte of the text. Repeated rows each give a
    row; an empty table gives an empty result. Only the two named columns are
    read, and no rows are shuffled.
    """
    if least < LEAST_PERIODS:
        raise ValueError(f"a run of {LEAST_PERIODS} periods has {LEAST_PERIODS} words at least")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                yield _found(part.column("id"), as_bytes(part.column("text")), least)

    return id_and_text(docs, id_column, text_column).mapInArrow(found, SCHEMA)
