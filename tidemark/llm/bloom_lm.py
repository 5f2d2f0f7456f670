"""Scoring by a language model whose n-gram counts live in a log-frequency Bloom filter.

A count is kept as its quantised logarithm, ``level(c)``, and an n-gram is put in
the filter once for each level up to its own. A reader probes level after level
until one is missing; the last one found is the count's logarithm. Errors are
one-sided and, as every level is a probe of its own, rare for high levels.

The filter grows with the corpus. It is built in segments: an n-gram's hash names
the one segment all its probes fall in, segments are the key of the only shuffle,
and each is filled by one task, which sizes it by the levels that go into it for a
given rate of false passes. There are as many segments as the corpus calls for.

A filter within ``BROADCAST_BYTES`` is broadcast. A larger one stays where it is:
the distinct n-grams of each slice of texts go to their segments, packed, and
their levels come back to the slice. Both ways give the same scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (
    as_bytes, as_list, column, kept, numbered, remainder, slices)
from tidemark.session import fresh_name

SEGMENT_GRAMS = 1 << 20
PROBES = 2
FALSE_PASS = 0.0625
BROADCAST_BYTES = 96 << 20
PROBED_BYTES = 32 << 20
LEVELS_PER_DOUBLING = 2
MAX_LEVEL = 96
ORDER = 2
MIXED = 0.3
PRIOR = 1.0
FREQUENT_WORDS = 200_000
FREQUENT_BYTES = 8 << 20
PIECE_BYTES = 2 << 20
TEXT_BYTES = 1 << 20
SEED = 7
END = b"\n"
PARTIAL = (
    "id long, text_key long, word binary, weight double, rest double, n_rows long, n_tokens long, "
    "n_known long, base double, own double"
)


class Filter(NamedTuple):
    """All segments' bits one after another, and where each starts (bytes) and how many bits it has."""

    data: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray


class Split(NamedTuple):
    """Documents whose ``crc32(id) mod divisor`` is ``held_out`` teach nothing."""

    divisor: int
    held_out: int


def level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and ``LEVELS_PER_DOUBLING`` more for each doubling."""
    found = 1 + np.floor(np.log2(np.maximum(counts, 1)) * LEVELS_PER_DOUBLING + 1e-9)
    return np.minimum(found, MAX_LEVEL).astype(np.int64)


# The geometric middle of the counts that share a level; 0 for none.
COUNT_OF_LEVEL = np.concatenate((
    [0.0, 1.0], 2.0 ** ((np.arange(2, MAX_LEVEL + 1) - 0.5) / LEVELS_PER_DOUBLING)))


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` of a row of word hashes."""
    count = max(0, len(words) - size + 1)
    found = np.full(count, size, np.uint64)
    for step in range(size):
        found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + words[step:step + count])
    return found


def _at_level(grams: np.ndarray, at: int) -> np.ndarray:
    """What the places of one level's probes are read off."""
    return _mix(grams + np.uint64(at * 0xD1B54A32D192ED03 % (1 << 64)))


def _place(mixed: np.ndarray, probe: int, sizes: np.ndarray | np.uint64) -> np.ndarray:
    """Bit places of one probe, inside segments of ``sizes`` bits."""
    half = mixed + np.uint64(probe) * (mixed >> np.uint64(32)) if probe else mixed
    return ((half & np.uint64(0xFFFFFFFF)) * sizes >> np.uint64(32)).view(np.int64)


def _segments(grams: np.ndarray, count: int) -> np.ndarray:
    """The segment of each n-gram; ``count`` is a power of two, and hashes in order give segments in order."""
    bits = count.bit_length() - 1
    return (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)


def segment_size(levels: int, false_pass: float) -> int:
    """Bits for so many levels, of which one not put in passes all its probes at the given rate."""
    return 64 + math.ceil(levels * PROBES / -math.log1p(-false_pass ** (1 / PROBES)))


def fill(grams: np.ndarray, counts: np.ndarray, false_pass: float) -> tuple[int, np.ndarray]:
    """One segment's number of bits, and the bits, from its n-grams and their counts."""
    levels = level(counts)
    size = segment_size(int(levels.sum()), false_pass)
    bits = np.zeros(size, bool)
    at = 1
    while grams.size:
        mixed = _at_level(grams, at)
        for probe in range(PROBES):
            bits[_place(mixed, probe, np.uint64(size))] = True
        at += 1
        more = levels >= at
        grams, levels = grams[more], levels[more]
    return size, np.packbits(bits, bitorder="little")


def levels_of(held: Filter, grams: np.ndarray) -> np.ndarray:
    """The levels the filter gives back, by probing one after another."""
    levels = np.zeros(len(grams), np.uint8)
    alive = np.arange(len(grams))
    segment = _segments(grams, len(held.sizes))
    base, size = held.starts[segment], held.sizes[segment].astype(np.uint64)
    for at in range(1, MAX_LEVEL + 1):
        mixed = _at_level(grams, at)
        for probe in range(PROBES):
            place = _place(mixed, probe, size)
            there = np.flatnonzero(held.data[base + (place >> 3)] >> (place & 7).astype(np.uint8) & 1)
            if there.size < alive.size:
                alive, grams, base, size, mixed = (one[there] for one in (alive, grams, base, size, mixed))
        if not alive.size:
            break
        levels[alive] = at
    return levels


class _Hashes:
    """The words seen most, ordered by hash, with their training counts."""

    def __init__(self, packed: Iterable[tuple[bytes, bytes]] = ()) -> None:
        words, counts = [], [np.zeros(0, "<i8")]
        for own, theirs in packed:
            words += own.split(b" ")
            counts.append(np.frombuffer(theirs, "<i8"))
        hashes = _hashes(words)
        by = np.argsort(hashes)
        self.words = pa.array(words, pa.large_binary()).take(pa.array(by))
        self.hashes = hashes[by]
        # The last place is that of any other word.
        self.counts = np.append(np.concatenate(counts)[by], -1)
        self.levels: np.ndarray | None = None

    def numbers(self, words: pa.LargeBinaryArray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those not held: found by its hash, then compared."""
        found = np.full(len(words), -1)
        by = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[by])
        near = np.flatnonzero(at < len(self.hashes))
        near = near[self.hashes[at[near]] == hashes[by[near]]]
        by, at = by[near], at[near]
        same = pc.equal(words.take(pa.array(by)), self.words.take(pa.array(at))).to_numpy(False)
        found[by[same]] = at[same]
        return found


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))


def _teaches(ident: int | None, split: Split) -> bool:
    return zlib.crc32(b"" if ident is None else b"%d" % ident) % split.divisor != split.held_out


def _source(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(column(text_column).cast("string"), F.lit(""))
    return docs.select(column(id_column).cast("long").alias("id"), text.alias("text"),
                       F.xxhash64(text).alias("text_key"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
    """Ids and texts, of which few are taken out of Arrow's memory at a time."""
    for batch in batches:
        for part in slices(batch, TEXT_BYTES):
            yield from zip(part.column("id").to_pylist(), as_bytes(part.column("text")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts, of about ``PIECE_BYTES`` together or one longer text, whatever the batches."""
    ids, texts, size = [], [], 0
    for ident, text in _rows(batches):
        ids.append(ident)
        texts.append(text.lower())
        size += len(text) + 64
        if size > PIECE_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def word_counts(source: DataFrame, split: Split) -> DataFrame:
    """``word``, ``taught`` (its count in training documents) and ``seen`` (in all); ends included."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _pieces(batches):
            words, of, ends = numbered(texts)
            teaches = np.array([_teaches(ident, split) for ident in ids])
            seen = np.bincount(of, minlength=len(words))
            taught = np.bincount(of[np.repeat(teaches, np.diff(ends, prepend=0))], minlength=len(words))
            # An empty text may leave an empty word that no token has.
            real = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([words.take(pa.array(real)), pa.array([END], pa.large_binary())]).cast(pa.binary()),
                pa.array(np.append(taught[real], teaches.sum())), pa.array(np.append(seen[real], len(ids))),
            ], names=["word", "taught", "seen"])

    return (
        source.select("id", "text").mapInArrow(counted, "word binary, taught long, seen long")
        .groupBy("word").agg(F.sum("taught").alias("taught"), F.sum("seen").alias("seen"))
    )


def _packed(
    batches: Iterator[pa.RecordBatch], split: Split, order: int, segments: int
) -> Iterator[pa.RecordBatch]:
    """N-grams of training documents and their counts, packed by segment."""
    for ids, texts in _pieces(batches):
        texts = [text for ident, text in zip(ids, texts) if _teaches(ident, split)]
        if not texts:
            continue
        words, of, lengths = _with_ends(texts)
        own = _hashes(as_list(words))
        times = np.bincount(of, minlength=len(words))
        # Every text has an end mark before it, too.
        times[-1] += len(texts)
        real = np.flatnonzero(times)
        grams, counts = [gram_hashes(own[real], 1)], [times[real]]
        for _, runs in _runs(own, of, lengths, order):
            found, times = np.unique(runs, return_counts=True)
            grams.append(found)
            counts.append(times)
        by = np.argsort(all_grams := np.concatenate(grams), kind="stable")
        yield _by_segment(all_grams[by], segments, counts=np.concatenate(counts)[by].astype("<u4"))


def _by_segment(grams: np.ndarray, segments: int, **others: np.ndarray) -> pa.RecordBatch:
    """Ascending hashes, and what belongs to them, as one packed row for each segment."""
    of = _segments(grams, segments)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    cuts = [*first.tolist(), len(of)]
    packed = {name: pa.array([all_[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())
              for name, all_ in {"grams": grams, **others}.items()}
    return pa.RecordBatch.from_pydict({"segment": pa.array(of[first]), **packed})


def segment_count(tokens: int, order: int) -> int:
    """A power of two, such that no segment has to add up much over ``SEGMENT_GRAMS`` n-grams."""
    return 1 << max(0, math.ceil(order * tokens / SEGMENT_GRAMS) - 1).bit_length()


def build_filter(
    source: DataFrame, split: Split, order: int, segments: int, false_pass: float
) -> DataFrame:
    """``segment``, ``size`` (in bits) and ``bits`` of the filter over the training documents' n-grams.

    Counts are added up per Arrow slice, then per segment. With the number of
    segments that ``segment_count`` gives, no task grows with the corpus.
    """

    def filled(table: pa.Table) -> pa.Table:
        grams = np.frombuffer(b"".join(table.column("grams").to_pylist()), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4")
        by = np.argsort(grams)
        grams = grams[by]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        size, bits = fill(grams[first], np.add.reduceat(counts[by], first, dtype=np.int64), false_pass)
        return pa.table({"segment": table.column("segment")[:1], "size": pa.array([size]),
                         "bits": pa.array([bits.tobytes()], pa.binary())})

    return (
        source.select("id", "text")
        .mapInArrow(lambda batches: _packed(batches, split, order, segments),
                    "segment long, grams binary, counts binary")
        .groupBy("segment").applyInArrow(filled, "segment long, size long, bits binary")
    )


def _gather(kept_segments: DataFrame, segments: int, total: int) -> Filter:
    """The whole filter on the driver, whose ``total`` bytes the caller has checked."""
    data = np.zeros(total + 8, np.uint8)
    # A segment without any n-gram reads as 64 clear bits.
    starts, sizes = np.full(segments, total, np.int64), np.full(segments, 64, np.int64)
    at = 0
    for row in kept_segments.toLocalIterator():
        bits = np.frombuffer(row["bits"], np.uint8)
        data[at:at + len(bits)] = bits
        starts[row["segment"]], sizes[row["segment"]] = at, row["size"]
        at += len(bits)
    return Filter(data, starts, sizes)


def _frequent(counts: DataFrame) -> list[tuple[bytes, bytes]]:
    """Training counts of the words seen most, packed by partition.

    At most ``FREQUENT_WORDS`` words of ``FREQUENT_BYTES`` in all.

    The least number of occurrences is read off a table of sizes, so the words
    need no global sort; the driver only passes the packed bytes on.
    """
    sizes = sorted(
        ((row["size"], row["words"], row["held"]) for row in
         counts.groupBy(F.floor(F.log2("seen") * 8).alias("size"))
         .agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("held"))
         .collect()), reverse=True)
    least, total, held = None, 0, 0
    for size, words, own in sizes:
        total, held = total + words, held + own
        if total > FREQUENT_WORDS or held > FREQUENT_BYTES:
            break
        least = size
    if least is None:
        return []

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, taught = batch.column("word").to_pylist(), batch.column("taught").to_numpy()
            if words:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b" ".join(words)], pa.binary()),
                     pa.array([taught.astype("<i8").tobytes()], pa.binary())],
                    names=["words", "counts"])

    chosen = counts.where(F.floor(F.log2("seen") * 8) >= least).select("word", "taught")
    return [(bytes(row["words"]), bytes(row["counts"])) for row in
            chosen.mapInArrow(packed, "words binary, counts binary").collect()]


_VOCABULARIES: dict[str, _Hashes] = {}


def _vocabulary(key: str, packed: list[tuple[bytes, bytes]]) -> _Hashes:
    """The packed counts by word, made once per worker process."""
    if key not in _VOCABULARIES:
        _VOCABULARIES.clear()
        _VOCABULARIES[key] = _Hashes(packed)
    return _VOCABULARIES[key]


def score_documents(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    split: Split = Split(7, 2),
    order: int = ORDER,
    false_pass: float = FALSE_PASS,
    prior: float = PRIOR,
) -> DataFrame:
    """One row per input row: the base score of single words, and the model's score.

    ``base_score`` adds up ``log10((c + 1) / (N + V + 1))`` with exact counts. The
    model refines that share by the words before, one more at a time:
    ``trust * count(h, w) / count(h) + (1 - trust) * lower``, with ``lower`` what
    the shorter history gives, and a ``trust`` that rises with the history's
    count, ``MIXED * count(h) / (count(h) + prior)``. Both counts are read from the filter, so they are
    the middles of their levels; ``false_pass`` is the rate at which a level that
    was not counted reads as if it were. The text starts, like it ends,
    with an end mark. Counts of the words seen most (``FREQUENT_WORDS``, ``FREQUENT_BYTES``) are
    broadcast; the others meet their counts in a join, so no vocabulary is too
    large.

    A null text is an empty one, which is its end mark alone; a null id counts as
    the empty text in the split. Texts of any length are scored whole; repeated
    rows each teach and each give a row. Without training documents N and V are
    zero. An empty table gives an empty result. Only the two named columns are
    read.
    """
    spark = docs.sparkSession
    source = _source(docs, id_column, text_column)
    counts = kept(word_counts(source, split), "words")
    totals = counts.agg(F.sum("taught"), F.sum((F.col("taught") > 0).cast("long"))).first()
    tokens, kinds = totals[0] or 0, totals[1] or 0
    whole = tokens + kinds + 1
    segments = segment_count(tokens, order)
    built = kept(build_filter(source, split, order, segments, false_pass), "filter")
    held_bytes = built.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    shared = spark.sparkContext.broadcast((fresh_name("words"), _frequent(counts)))
    if held_bytes <= BROADCAST_BYTES:
        gathered = spark.sparkContext.broadcast(_gather(built, segments, held_bytes))

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = _vocabulary(*shared.value)
            for batch in batches:
                for part in slices(batch, TEXT_BYTES):
                    laid = _lay(part, hashes, order)
                    yield from _score_part(
                        part, laid, _levels(gathered.value, laid, hashes), hashes, whole, prior)

        partial = source.mapInArrow(scored, PARTIAL)
    else:
        parted, answers = _ask_segments(source, built, segments, order)

        def answered(texts: pa.Table, found: pa.Table) -> pa.Table:
            row = texts.to_pylist()[0]
            part = pa.RecordBatch.from_pydict({
                "id": pa.array(row["ids"], pa.int64()), "text_key": pa.array(row["keys"], pa.int64()),
                "text": pa.array(row["texts"], pa.large_binary())})
            by = sorted(zip(found.column("segment").to_pylist(), found.column("levels").to_pylist()))
            levels = np.frombuffer(b"".join([one for _, one in by]), np.uint8)
            hashes = _vocabulary(*shared.value)
            laid = _lay(part, hashes, order)
            levels = levels[np.unique(laid.grams, return_inverse=True)[1]]
            return pa.Table.from_batches(list(_score_part(part, laid, levels, hashes, whole, prior)))

        partial = parted.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(answered, PARTIAL)
    rare = F.coalesce("taught", F.lit(0))
    share = (rare + 1) / F.lit(float(whole))
    is_word = F.col("n_rows") == 0
    met = partial.join(counts.select("word", "taught"), "word", "left").select(
        "id", "text_key", "n_rows", "n_tokens",
        F.when(is_word, (rare > 0).cast("long")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(is_word, F.log10(share)).otherwise(F.col("base")).alias("base"),
        F.when(is_word, F.log10(F.col("weight") + F.col("rest") * share)).otherwise(F.col("own")).alias("own"))
    summed = met.groupBy("id", "text_key").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("own").alias("own"))
    # Rows that are alike in id and text were added up together: share out, then repeat.
    one = lambda name: (F.col(name) / F.col("n_rows")).cast("long")
    return summed.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).select(
        "id",
        (_fold(F.col("id"), split) == split.held_out).alias("held_out"),
        one("n_tokens").alias("n_tokens"),
        one("n_known").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("n_rows")).alias("base_score"),
        (F.col("own") / F.col("n_rows")).alias("score"),
    )


def _fold(ident: Column, split: Split) -> Column:
    return remainder(ident, split.divisor)


class _Laid(NamedTuple):
    """A slice's distinct ``words``, their ``numbers`` among the words seen most, the word of each token
    in turn (``of``), and the distinct n-grams the tokens' shares need: those of one word first, word by word.

    ``places`` has, for each history's length, the tokens that have such a
    history, and where the n-gram and the history stand in ``grams``.
    """

    words: list[bytes]
    numbers: np.ndarray
    of: np.ndarray
    lengths: np.ndarray
    grams: np.ndarray
    places: list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _with_ends(texts: list[bytes]) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Distinct words, the number of each token in turn, and the tokens of each text; the end mark is the last word."""
    words, of, ends = numbered(texts)
    of = np.insert(of, ends, len(words))
    words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
    return words, of, np.diff(ends, prepend=0) + 1


def _runs(
    own: np.ndarray, of: np.ndarray, lengths: np.ndarray, order: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size from 2 on, the tokens that end a run of so many, and the runs' hashes.

    ``own`` has the hash of each word. A text's first token follows an end mark; no
    run reaches before that.
    """
    # The end mark before a text is the one after the text before.
    laid = own[np.append(of[-1:], of)]
    room = np.arange(1, len(of) + 1) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    for size in range(2, order + 1):
        runs = gram_hashes(laid, size)
        if size == 2:
            yield np.arange(len(of)), runs
        else:
            ending = np.flatnonzero(room >= size - 1)
            yield ending, runs[ending - (size - 2)]


def _lay(part: pa.RecordBatch, hashes: _Hashes, order: int) -> _Laid:
    coded, of, lengths = _with_ends([text.lower() for text in as_bytes(part.column("text"))])
    words = as_list(coded)
    own = _hashes(words)
    grams, places = [], []
    # Where the run stands that is one shorter and ends with a token.
    shorter = of
    for ending, runs in _runs(own, of, lengths, order):
        grams = grams or [gram_hashes(own, 1)]
        runs, at = np.unique(runs, return_inverse=True)
        at += sum(map(len, grams))
        # For a text's first token this is the end mark of the text before, which is any end mark.
        places.append((ending, at, shorter[ending - 1]))
        shorter = np.full(len(of), -1)
        shorter[ending] = at
        grams.append(runs)
    all_grams = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    return _Laid(words, hashes.numbers(coded, own), of, lengths, all_grams, places)


def _levels(held: Filter, laid: _Laid, hashes: _Hashes) -> np.ndarray:
    """Levels of ``laid.grams``; those of the words seen most are probed once per worker process."""
    if not laid.places:
        return np.zeros(0, np.uint8)
    if hashes.levels is None:
        hashes.levels = np.append(levels_of(held, gram_hashes(hashes.hashes, 1)), np.uint8(0))
    others = np.flatnonzero(np.append(laid.numbers < 0, np.ones(len(laid.grams) - len(laid.words), bool)))
    levels = np.zeros(len(laid.grams), np.uint8)
    levels[:len(laid.words)] = hashes.levels[laid.numbers]
    levels[others] = levels_of(held, laid.grams[others])
    return levels


def _ask_segments(
    source: DataFrame, built: DataFrame, segments: int, order: int
) -> tuple[DataFrame, DataFrame]:
    """Slices of texts under a number each, and the levels of their n-grams by slice and segment.

    A segment that is asked for over ``PROBED_BYTES`` is copied to as many tasks as
    that takes, and each slice asks one of them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array([number]),
                    "ids": pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                    "keys": pa.array([part.column("text_key").to_pylist()], pa.list_(pa.int64())),
                    "texts": pa.array([as_bytes(part.column("text"))], pa.list_(pa.binary()))})
                number += 1

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for number, texts in zip(*(batch.column(name).to_pylist() for name in ("slice", "texts"))):
                part = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_binary())})
                rows = _by_segment(np.unique(_lay(part, hashes, order).grams), segments)
                yield rows.append_column("slice", pa.array(np.full(rows.num_rows, number)))

    def answered(rows: pa.Table, segment: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"slice": [], "segment": [], "levels": []}, schema=pa.schema(
                [("slice", pa.int64()), ("segment", pa.int64()), ("levels", pa.binary())]))
        packed = rows.column("grams").to_pylist()
        grams = np.frombuffer(b"".join(packed), np.uint64)
        if segment.num_rows:
            levels = _levels_in(segment, grams).tobytes()
        else:
            levels = bytes(len(grams))
        cuts = (np.cumsum([0, *map(len, packed)]) >> 3).tolist()
        return pa.table({
            "slice": rows.column("slice"), "segment": rows.column("segment"),
            "levels": pa.array([levels[i:j] for i, j in zip(cuts, cuts[1:])], pa.binary())})

    parted = kept(source.mapInArrow(
        cut, "slice long, ids array<long>, keys array<long>, texts array<binary>"), "slices")
    probes = kept(parted.select("slice", "texts").mapInArrow(
        asked, "segment long, grams binary, slice long"), "probes")
    copies = (
        probes.groupBy("segment").agg(F.sum(F.octet_length("grams")).alias("asked"))
        .select("segment", F.ceil(F.col("asked") / PROBED_BYTES).alias("copies"))
        .where(F.col("copies") > 1)
    )
    many = F.coalesce("copies", F.lit(1))
    rows = probes.join(F.broadcast(copies), "segment", "left").select(
        "segment", "grams", "slice", F.pmod(F.xxhash64("slice"), many).alias("copy"))
    placed = built.join(F.broadcast(copies), "segment", "left").select(
        "segment", "size", "bits", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("copy"))
    answers = rows.groupBy("segment", "copy").cogroup(placed.groupBy("segment", "copy")).applyInArrow(
        answered, "slice long, segment long, levels binary")
    return parted, answers


def _levels_in(segment: pa.Table, grams: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(segment.column("bits")[0].as_py(), np.uint8)
    one = Filter(bits, np.zeros(1, np.int64), np.array([segment.column("size")[0].as_py()]))
    return levels_of(one, grams)


def _score_part(
    part: pa.RecordBatch, laid: _Laid, levels: np.ndarray, hashes: _Hashes,
    whole: int, prior: float,
) -> Iterator[pa.RecordBatch]:
    """A row of sums for each text, and a row for each word whose count has to be looked up."""
    words, of, lengths = laid.words, laid.of, laid.lengths
    ends = np.cumsum(lengths)
    starts = ends - lengths
    counts = COUNT_OF_LEVEL[levels]
    # A word's probability is weight + rest * share, whatever its share turns out to be.
    weight, rest = np.zeros(len(of)), np.ones(len(of))
    for inside, gram, history in laid.places:
        before = counts[history]
        after = np.minimum(counts[gram], before)
        lower = 1 - MIXED * before / (before + prior)
        weight[inside] = MIXED * after / (before + prior) + lower * weight[inside]
        rest[inside] *= lower
    known = hashes.counts[laid.numbers][of]
    rare = np.flatnonzero(known < 0)
    share = (known + 1) / whole
    with np.errstate(divide="ignore"):
        base, mine = np.log10(share), np.log10(weight + rest * share)
    base[rare] = mine[rare] = 0
    ids, keys = part.column("id").to_pylist(), part.column("text_key").to_pylist()
    names = ["id", "text_key", "word", "weight", "rest", "n_rows", "n_tokens", "n_known", "base", "own"]
    count = part.num_rows
    yield pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(keys, pa.int64()),
        # White space is in no word, so these meet no count; each goes its own way.
        pa.array([f" {one} {key}".encode() for one, key in zip(ids, keys)], pa.binary()),
        pa.array(np.zeros(count)), pa.array(np.zeros(count)),
        pa.array(np.ones(count, np.int64)), pa.array(lengths),
        pa.array(np.add.reduceat((known > 0).astype(np.int64), starts)),
        pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(mine, starts)),
    ], names=names)
    if rare.size:
        text = np.searchsorted(ends, rare, "right")
        none = pa.array(np.zeros(rare.size, np.int64))
        yield pa.RecordBatch.from_arrays([
            pa.array(ids, pa.int64()).take(pa.array(text)), pa.array(keys, pa.int64()).take(pa.array(text)),
            pa.array(words, pa.binary()).take(pa.array(of[rare])), pa.array(weight[rare]),
            pa.array(rest[rare]), none, none, none,
            pa.array(np.zeros(rare.size)), pa.array(np.zeros(rare.size)),
        ], names=names)
