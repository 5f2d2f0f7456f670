"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word is embedded as the sum of hashed vectors of the word and of its first
four and six bytes, so that forms of one stem share what is learnt. Filters of
one, two and three words slide over the text, each filter's largest answer is
kept, and a logistic layer weighs them. Training takes every labelled row, in
shards; scoring reads every text whole.
"""

from __future__ import annotations

import itertools
import math
import pickle
import zlib
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import alnum_words, as_bytes, column, kept, remainder, slices
from tidemark.session import scratch_path

BUCKETS = 1 << 16
SIZE = 12
FILTERS = 8
WIDTHS = (1, 2, 3)
PARTS = sum(WIDTHS)
PAD = max(WIDTHS)
# A shard of the labelled rows is what one task trains on at a time.
SHARD_ROWS = 12_000
SHARD_BYTES = 128 << 20
# Labels up to this many are broadcast to the documents, more are joined by a shuffle.
BROADCAST_LABELS = 1 << 21
RUN_WORDS = 1 << 15
# Ranges of score that are counted apart, for each unit of the log of its odds.
CELLS = 32
EPOCHS = 3
LEAST_STEPS = 800
LEAST_DOCS = 2
BATCH = 32
FOLDS = 4
HELD_OUT = 2
CALIBRATION = 3
LEAST_THRESHOLD, MOST_THRESHOLD = 0.3, 0.9
CACHED_WORDS = 200_000
TEXT_BYTES = 4 << 20
SCHEMA = "id long, score double, threshold double, toxic boolean"


class Model(NamedTuple):
    """Word vectors by bucket, filters (size x parts x filters), biases, the last layer, thresholds."""

    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    thresholds: dict[str | None, float]


def word_buckets(word: bytes) -> tuple[int, int, int]:
    """The buckets of a word: its own, and those of its first four and six bytes."""
    crc = zlib.crc32
    return (crc(word) % BUCKETS, crc(word[:4], 1) % BUCKETS, crc(word[:6], 2) % BUCKETS)


def _responses(parts: np.ndarray, count: int) -> list[np.ndarray]:
    """Answers of the filters of each width at the first ``count`` places of laid-out words."""
    found, at = [], 0
    for width in WIDTHS:
        total = parts[:count, at]
        for step in range(1, width):
            total = total + parts[step:count + step, at + step]
        found.append(total)
        at += width
    return found


class State(NamedTuple):
    """A model under training: word vectors and their step sizes, the dense weights
    (filters, bias, weight, offset) with their running moments, and the steps taken."""

    vectors: np.ndarray
    spread: np.ndarray
    dense: list[np.ndarray]
    first: list[np.ndarray]
    second: list[np.ndarray]
    step: int
    rng: np.random.Generator


def begin(met: np.ndarray, share: float, seed: int = 1) -> State:
    """Where training starts: ``met`` tells in how many documents each bucket occurs.

    Buckets met in fewer than ``LEAST_DOCS`` documents can teach nothing about
    others; they, and buckets never met, have a vector of zeros.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS + 1, SIZE)).astype(np.float32)
    vectors[np.append(met < LEAST_DOCS, True)] = 0
    filters = rng.normal(0, 0.3, (SIZE, PARTS * FILTERS)).astype(np.float32)
    bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
    weight = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
    dense = [filters, bias, weight, np.array([math.log(share / (1 - share))], np.float32)]
    return State(vectors, np.full((BUCKETS + 1, 1), 1e-6, np.float32), dense,
                 [np.zeros_like(one) for one in dense], [np.zeros_like(one) for one in dense], 0, rng)


def known_buckets(met: np.ndarray) -> np.ndarray:
    """For each bucket itself, or ``BUCKETS`` if too few documents have it."""
    return np.where(met >= LEAST_DOCS, np.arange(BUCKETS, dtype=np.int32), BUCKETS).astype(np.int32)


def finished(state: State, learnt: bool = True) -> Model:
    """The model of a state; not ``learnt`` (labels of one kind), it scores all texts alike."""
    filters, bias, weight, offset = state.dense
    return Model(state.vectors, filters, bias, weight if learnt else 0 * weight, float(offset[0]), {})


def count_met(docs: list[np.ndarray]) -> np.ndarray:
    """In how many documents each bucket occurs."""
    met = np.zeros(BUCKETS, np.int64)
    for one in docs:
        met[one.ravel()] += 1  # once for each distinct index
    return met


def epochs_for(rows: float) -> int:
    """Passes over so many rows."""
    return max(EPOCHS, math.ceil(LEAST_STEPS * BATCH / rows))


def learn(
    state: State, docs: list[np.ndarray], labels: np.ndarray, known: np.ndarray,
    epochs: range, of: int, rng: np.random.Generator | None = None,
) -> State:
    """``state`` after the passes ``epochs``, of ``of`` in all, over the documents."""
    rng = rng or state.rng
    step = state.step
    for epoch in epochs:
        order = rng.permutation(len(docs))
        for start in range(0, len(order), BATCH):
            step += 1
            _step(docs, labels, order[start:start + BATCH], known, state, step, 0.01 * (1 - epoch / of))
    return state._replace(step=step)


def fit(docs: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Model:
    """Train on documents given as (words x 3) bucket arrays; without thresholds.

    With labels of one kind only, or none, the score is that kind's share for
    every text (one half if there are none).
    """
    met = count_met(docs)
    state = begin(met, (labels.sum() + 0.5) / (len(labels) + 1), seed)
    if len(set(labels.tolist())) < 2:
        return finished(state, learnt=False)
    epochs = epochs_for(len(docs))
    return finished(learn(state, docs, labels, known_buckets(met), range(epochs), epochs))


def _runs(docs: list[np.ndarray]) -> Iterator[list[tuple[int, int, int]]]:
    """The documents in runs of about ``RUN_WORDS``, as (row, first, end); longer ones in pieces."""
    run, words = [], 0
    for row, one in enumerate(docs):
        for first in range(0, max(1, len(one)), RUN_WORDS):
            end = min(len(one), first + RUN_WORDS)
            if run and words + end - first > RUN_WORDS:
                yield run
                run, words = [], 0
            run.append((row, first, end))
            words += end - first
    if run:
        yield run


def _pool(
    vectors: np.ndarray, filters: np.ndarray, docs: list[np.ndarray], known: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest answer in each document, and the buckets of the words that gave it."""
    pooled = np.full((len(docs), len(WIDTHS), FILTERS), -np.inf, np.float32)
    where = np.full((len(docs), len(WIDTHS), FILTERS, PAD, 3), BUCKETS, np.int32)
    each = np.arange(FILTERS)
    for run in _runs(docs):
        lengths = np.array([end - first for _, first, end in run])
        starts = np.concatenate(([0], np.cumsum(lengths + PAD)[:-1]))
        buckets = np.full((int((lengths + PAD).sum()) + PAD, 3), BUCKETS, np.int32)
        for (row, first, end), start in zip(run, starts):
            ahead = docs[row][first:end + PAD]
            buckets[start:start + len(ahead)] = known[ahead]
        words = vectors[buckets[:, 0]] + vectors[buckets[:, 1]] + vectors[buckets[:, 2]]
        parts = (words @ filters).reshape(len(words), PARTS, FILTERS)
        answers = _responses(parts, len(words) - PAD)
        best = np.empty((len(run), len(WIDTHS), FILTERS), np.int64)
        for at, ((row, first, end), start) in enumerate(zip(run, starts)):
            # Where a document ends, a window of padding only counts too.
            stop = start + end - first + (end == len(docs[row]))
            for kind, answer in enumerate(answers):
                best[at, kind] = start + answer[start:stop].argmax(0)
        values = np.stack([answer[best[:, kind], each] for kind, answer in enumerate(answers)], 1)
        found = buckets[best[..., None] + np.arange(PAD)]
        for at, (row, _, _) in enumerate(run):
            better = values[at] > pooled[row]
            pooled[row][better] = values[at][better]
            where[row][better] = found[at][better]
    return pooled, where


def _step(docs, labels, chosen, known, state, step, rate) -> None:
    """One update of all weights from the documents ``chosen``."""
    vectors, spread, dense = state.vectors, state.spread, state.dense
    filters, bias, weight, offset = dense
    pooled, where = _pool(vectors, filters, [docs[at] for at in chosen], known)
    pooled = np.maximum(pooled.reshape(len(chosen), -1) + bias, 0)
    error = (1 / (1 + np.exp(-(pooled @ weight + offset[0]))) - labels[chosen]).astype(np.float32)
    error /= len(chosen)
    down = error[:, None] * weight * (pooled > 0)
    touched, part, size = [], [], []
    at = 0
    for kind, width in enumerate(WIDTHS):
        value = down[:, kind * FILTERS:(kind + 1) * FILTERS]
        for move in range(width):
            touched.append(where[:, kind, :, move].reshape(-1, 3))
            part.append(np.tile(np.arange(FILTERS) + (at + move) * FILTERS, len(chosen)))
            size.append(value.ravel())
        at += width
    touched, part, size = map(np.concatenate, (touched, part, size))
    used = np.flatnonzero(size)
    touched, part, size = touched[used], part[used], size[used, None]
    words = vectors[touched[:, 0]] + vectors[touched[:, 1]] + vectors[touched[:, 2]]
    to_filters = np.zeros_like(filters.T)
    np.add.at(to_filters, part, words * size)
    to_words = filters.T[part] * size
    touched = touched.ravel()
    real = touched < BUCKETS
    hit, place = np.unique(touched[real], return_inverse=True)
    to_vectors = np.zeros((hit.size, SIZE), np.float32)
    np.add.at(to_vectors, place, np.repeat(to_words, 3, 0)[real])
    spread[hit] += (to_vectors ** 2).mean(1, keepdims=True)
    vectors[hit] -= 10 * rate * to_vectors / np.sqrt(spread[hit])
    slopes = (to_filters.T, down.sum(0), pooled.T @ error, np.array([error.sum()]))
    for one, slope, m, v in zip(dense, slopes, state.first, state.second):
        m += 0.1 * (slope - m)
        v += 0.001 * (slope ** 2 - v)
        one -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)


class Scorer:
    """Scores texts; each word's answers to all filter parts are worked out once and remembered."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.parts = np.zeros((1, PARTS, FILTERS), np.float32)

    def _learn(self, words: set[bytes]) -> None:
        new = [word for word in words if word not in self.places]
        if not new:
            return
        self.places.update((word, at) for at, word in enumerate(new, len(self.parts)))
        buckets = np.array([word_buckets(word) for word in new])
        rows = self.model.vectors[buckets].sum(1) @ self.model.filters
        self.parts = np.concatenate((self.parts, rows.reshape(-1, PARTS, FILTERS)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 for each text; a text without words is all padding."""
        if len(self.places) > CACHED_WORDS:
            self._forget()
        split = [alnum_words(text) for text in texts]
        self._learn(set().union(*split))
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        ends = np.cumsum(lengths + PAD)
        starts = ends - lengths - PAD
        laid = np.zeros(int(ends[-1]) + PAD, np.int64)
        place = self.places.__getitem__
        for begin, words in zip(starts, split):
            laid[begin:begin + len(words)] = np.fromiter(map(place, words), np.int64, len(words))
        pooled = []
        inside = np.stack((starts, starts + lengths + 1), 1).ravel()
        for kind, width in enumerate(WIDTHS):
            at = sum(WIDTHS[:kind])
            answer = self.parts[laid[:len(laid) - PAD], at]
            for step in range(1, width):
                answer += self.parts[laid[step:len(laid) - PAD + step], at + step]
            pooled.append(np.maximum.reduceat(answer, inside, axis=0)[::2])
        return _logistic(self.model, np.concatenate(pooled, 1))


def _logistic(model: Model, pooled: np.ndarray) -> np.ndarray:
    """Probabilities from the filters' largest answers."""
    pooled = np.maximum(pooled + model.bias, 0)
    return 1 / (1 + np.exp(-(pooled @ model.weight + model.offset).astype(np.float64)))


def calibrate(
    scores: np.ndarray, labels: np.ndarray, langs: list[str | None]
) -> dict[str | None, float]:
    """The threshold of best F1 for each language and, under None, for all together.

    It lies midway between the two scores that it separates, but from
    ``LEAST_THRESHOLD`` to ``MOST_THRESHOLD``, as few rows tell little. Languages
    without both labels take the common one; without both labels at all it is 0.5.
    """
    found: dict[str | None, float] = {}
    for lang in [None, *sorted({lang for lang in langs if lang is not None})]:
        rows = np.array([lang is None or one == lang for one in langs], bool)
        own, marks = scores[rows], labels[rows]
        if len(set(marks.tolist())) < 2:
            if lang is None:
                found[None] = 0.5
            continue
        order = np.argsort(-own, kind="stable")
        own, marks = own[order], marks[order]
        right = np.cumsum(marks)
        last = np.append(own[1:] != own[:-1], True)
        f1 = np.where(last, 2 * right / (np.arange(1, len(own) + 1) + marks.sum()), -1)
        at = int(f1.argmax())
        middle = (own[at] + (own[at + 1] if at + 1 < len(own) else 0.0)) / 2
        found[lang] = float(np.clip(middle, LEAST_THRESHOLD, MOST_THRESHOLD))
    return found


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    label_id_column: str = "doc_id",
    label_column: str = "toxic",
) -> Model:
    """Fit on every labelled row, whatever its length.

    Rows of the held-out fold are never used. Thresholds are set on the whole
    calibration fold by a first model that has not seen it; the model returned is
    then fitted on all the rows. A null label counts as none, of several labels of a
    document the largest holds. The rows' word buckets are written once, in shards of
    about ``SHARD_ROWS`` rows. One shard is trained through in one task. Of several, each
    makes a pass of its own from the same weights; Spark averages what they learnt, and the
    next pass starts from that. Only the model, whose size is fixed, meets the driver.
    """
    spark = docs.sparkSession
    shards = _shards(docs, labels, id_column, text_column, lang_column, label_id_column, label_column)
    if shards is None:  # no labelled row at all
        return fit([], np.zeros(0))._replace(thresholds=calibrate(np.zeros(0), np.zeros(0), []))
    first = _fit_shards(shards, every=False)
    thresholds = best_thresholds(spark, _calibration_scores(shards, first))
    return _fit_shards(shards, every=True)._replace(thresholds=thresholds)


def _shards(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, lang_column: str,
    label_id_column: str, label_column: str,
) -> DataFrame | None:
    """The labelled rows' buckets, labels, folds and languages, kept, a file a shard; None without any."""
    marked = (
        labels.select(column(label_id_column).cast("long").alias("id"),
                      column(label_column).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .where(remainder(F.col("id"), FOLDS) != HELD_OUT)
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    source = _with_language(docs, id_column, text_column, lang_column)
    if marked.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        marked = F.broadcast(marked)
    else:
        source = source.where(remainder(F.col("id"), FOLDS) != HELD_OUT).hint("merge")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    total = source.select("id", size).join(marked, "id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).first()
    if not total["rows"]:
        return None
    count = max(-(-total["rows"] // SHARD_ROWS), -(-total["bytes"] // SHARD_BYTES))

    def laid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, int, int]] = {}
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                texts = as_bytes(part.column("text"))
                found = []
                for text in texts:
                    if len(known) > CACHED_WORDS:
                        known.clear()
                    words = alnum_words(text)
                    for word in set(words).difference(known):
                        known[word] = word_buckets(word)
                    found.append(np.array([known[word] for word in words], np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(list(map(zlib.crc32, texts)), pa.int64()),
                     pa.array(found, pa.binary()), part.column("label"), part.column("lang")],
                    names=["id", "crc", "buckets", "label", "lang"])

    rows = (
        source.join(marked, "id")
        .mapInArrow(laid, "id long, crc long, buckets binary, label int, lang string")
        .withColumn("fold", remainder(F.col("id"), FOLDS))
        .withColumn("shard", F.pmod(F.xxhash64("id", "crc"), F.lit(count)).cast("int"))
    )
    dealt = rows.repartitionById(count, F.col("shard")).sortWithinPartitions("shard", "id", "crc")
    return kept(dealt.select("shard", "buckets", "label", "fold", "lang"), "toxic-shards")


class _Shard(NamedTuple):
    number: int
    docs: list[np.ndarray]
    labels: np.ndarray
    langs: list[str | None]


def _read_shards(batches: Iterator[pa.RecordBatch], use) -> Iterator[_Shard]:
    """The shards that a task reads, with only the rows whose fold ``use`` takes, one at a time."""
    rows = (
        row for batch in batches
        for row in zip(*(batch.column(name).to_pylist()
                         for name in ("shard", "buckets", "label", "lang", "fold"))) if use(row[4])
    )
    for number, own in itertools.groupby(rows, lambda row: row[0]):
        docs, labels, langs = [], [], []
        for _, buckets, label, lang, _ in own:
            docs.append(np.frombuffer(buckets, np.uint16).reshape(-1, 3))
            labels.append(label)
            langs.append(lang)
        yield _Shard(number, docs, np.array(labels, np.float32), langs)


def _fit_shards(shards: DataFrame, every: bool) -> Model:
    """The model of all rows of the shards, or (not ``every``) of all but the calibration fold's."""
    spark = shards.sparkSession

    def use(fold: int) -> bool:
        return every or fold != CALIBRATION

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows and rows of label 1 come under two numbers past the buckets.
        for shard in _read_shards(batches, use):
            met = np.append(count_met(shard.docs), (len(shard.docs), int(shard.labels.sum())))
            at = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(met[at])], names=["at", "met"])

    sums = shards.mapInArrow(counted, "at long, met long").groupBy("at").agg(
        F.sum("met").alias("met"), F.count(F.lit(1)).alias("shards")).toArrow()
    met = np.zeros(BUCKETS + 2, np.int64)
    met[sums["at"].to_numpy()] = sums["met"].to_numpy()
    met, rows, ones = met[:BUCKETS], int(met[BUCKETS]), int(met[BUCKETS + 1])
    state = begin(met, (ones + 0.5) / (rows + 1))
    if not 0 < ones < rows:
        return finished(state, learnt=False)
    known = known_buckets(met)
    count = max(sums.filter(pc.equal(sums["at"], BUCKETS))["shards"].to_pylist())
    epochs = epochs_for(rows / count)
    # One shard needs no one to agree with: all its passes are one round.
    rounds = [range(epochs)] if count == 1 else [range(at, at + 1) for at in range(epochs)]
    for passes in rounds:
        shared = spark.sparkContext.broadcast((state, known))

        def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in _read_shards(batches, use):
                start, known = shared.value
                own = _copied(start)
                rng = None if count == 1 else np.random.default_rng((1, shard.number, passes.start))
                yield _changes(start, learn(own, shard.docs, shard.labels, known, passes, epochs, rng))

        names = ["at", *(f"v{at}" for at in range(SIZE + 1))]
        mean = shards.mapInArrow(learnt, "at int, " + ", ".join(f"{name} float" for name in names[1:])) \
            .groupBy("at").agg(*(F.avg(name).alias(name) for name in names[1:])).toArrow()
        state = _moved(state, np.stack([mean[name].to_numpy() for name in names], 1),
                       len(passes) * -(-rows // (count * BATCH)))
        shared.destroy()
    return finished(state)


def _copied(state: State) -> State:
    """A state of its own; a worker's tasks share the one that was sent."""
    return pickle.loads(pickle.dumps(state))


def _changes(start: State, end: State) -> pa.RecordBatch:
    """What was learnt, in rows of ``SIZE + 1`` numbers: the buckets that moved, then all dense weights."""
    # A small step may move a vector and be too small to show in its spread.
    at = np.flatnonzero((end.spread != start.spread)[:, 0] | (end.vectors != start.vectors).any(1))
    dense = np.concatenate([one.ravel() for kind in (end.dense, end.first, end.second) for one in kind])
    dense = np.pad(dense, (0, -len(dense) % (SIZE + 1))).reshape(-1, SIZE + 1)
    rows = np.concatenate((np.concatenate((end.vectors[at], end.spread[at]), 1), dense)).astype(np.float32)
    at = np.concatenate((at, BUCKETS + 1 + np.arange(len(dense))))
    return pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), *(pa.array(one) for one in rows.T.copy())],
        names=["at", *(f"v{at}" for at in range(SIZE + 1))])


def _moved(state: State, rows: np.ndarray, steps: int) -> State:
    """``state`` with the rows that ``_changes`` gives, one of each number, in its place."""
    at = rows[:, 0].astype(np.int64)
    words = at <= BUCKETS
    vectors, spread = state.vectors.copy(), state.spread.copy()
    vectors[at[words]] = rows[words, 1:SIZE + 1]
    spread[at[words], 0] = rows[words, SIZE + 1]
    dense = rows[~words][np.argsort(at[~words])][:, 1:].astype(np.float32).ravel()
    kinds, begin_at = [], 0
    for kind in (state.dense, state.first, state.second):
        kinds.append([])
        for one in kind:
            kinds[-1].append(dense[begin_at:begin_at + one.size].reshape(one.shape))
            begin_at += one.size
    return State(vectors, spread, *kinds, state.step + steps, state.rng)


def _calibration_scores(shards: DataFrame, model: Model) -> DataFrame:
    """Language, score and label of each row of the calibration fold."""
    shared = shards.sparkSession.sparkContext.broadcast(model)
    every = np.arange(BUCKETS, dtype=np.int32)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for shard in _read_shards(batches, lambda fold: fold == CALIBRATION):
            for start in range(0, len(shard.docs), BATCH):
                pooled, _ = _pool(model.vectors, model.filters, shard.docs[start:start + BATCH], every)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard.langs[start:start + BATCH], pa.string()),
                     pa.array(_logistic(model, pooled.reshape(len(pooled), -1))),
                     pa.array(shard.labels[start:start + BATCH].astype(np.int32))],
                    names=["lang", "score", "label"])

    return shards.mapInArrow(scored, "lang string, score double, label int")


def best_thresholds(spark: SparkSession, scored: DataFrame) -> dict[str | None, float]:
    """What ``calibrate`` gives for all rows of (lang, score, label), by Spark.

    Rows of one score are counted together. Running counts are taken within narrow
    ranges of score, to which the sums of the ranges above are added, so no
    language is one task's. Only a language's threshold leaves the cluster.
    """
    path = scratch_path(spark, "toxic-scores")
    # Scores crowd near 0 and 1; in the log of their odds they spread.
    odds = F.log(F.greatest("score", F.lit(1e-300)) / F.greatest(1 - F.col("score"), F.lit(1e-300)))
    every = F.array(F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("lang")),
                    F.struct(F.lit(False).alias("all"), F.col("lang")))
    counts = (
        scored.select("score", "label", F.explode(every).alias("of"))
        .where("of.all OR of.lang IS NOT NULL")
        .groupBy("of", "score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"))
        .withColumn("cell", F.floor(odds * CELLS))
    )
    counts.write.parquet(path)
    counts = spark.read.parquet(path)
    above = Window.partitionBy("of").orderBy(F.desc("cell"))
    before = above.rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        counts.groupBy("of", "cell").agg(F.sum("n").alias("cell_n"), F.sum("ones").alias("cell_ones"),
                                         F.max("score").alias("top"))
        .select("of", "cell", F.coalesce(F.sum("cell_n").over(before), F.lit(0)).alias("n_above"),
                F.coalesce(F.sum("cell_ones").over(before), F.lit(0)).alias("ones_above"),
                F.lead("top").over(above).alias("below"),
                F.sum("cell_ones").over(Window.partitionBy("of")).alias("all_ones"),
                F.sum("cell_n").over(Window.partitionBy("of")).alias("all_n"))
        .where("all_ones > 0 AND all_ones < all_n")
    )
    inside = Window.partitionBy("of", "cell").orderBy(F.desc("score"))
    f1 = 2 * F.col("right") / (F.col("taken") + F.col("all_ones"))
    found = (
        counts.join(cells, ["of", "cell"])
        .select("of", "score", "all_ones",
                (F.sum("n").over(inside) + F.col("n_above")).alias("taken"),
                (F.sum("ones").over(inside) + F.col("ones_above")).alias("right"),
                F.coalesce(F.lead("score").over(inside), "below", F.lit(0.0)).alias("next"))
        .groupBy("of").agg(F.max(F.struct(f1.alias("f1"), "score", "next")).alias("best"))
        .select("of.all", "of.lang", ((F.col("best.score") + F.col("best.next")) / 2).alias("middle"))
    )
    limits = {row["lang"]: float(np.clip(row["middle"], LEAST_THRESHOLD, MOST_THRESHOLD))
              for row in found.collect()}
    return {None: limits.pop(None, 0.5), **dict(sorted(limits.items()))}


def score_toxicity(
    docs: DataFrame,
    model: Model,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
) -> DataFrame:
    """One row per input row: id, score (0 to 1), its language's threshold, and the verdict.

    The score depends on the text alone. Null, empty and wordless texts are
    scored as a text of padding. The language only picks the threshold; a null,
    unknown or missing one takes the common threshold. Texts of any length are
    read whole; repeated rows each give a row; an empty table gives an empty
    result. Only the named columns are read. The model's size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, TEXT_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(scorer.scores(as_bytes(part.column("text")))),
                     part.column("lang")], names=["id", "score", "lang"])

    source = _with_language(docs, id_column, text_column, lang_column)
    threshold = _by_language(model.thresholds)
    return source.mapInArrow(scored, "id long, score double, lang string").select(
        "id", "score", threshold.alias("threshold"), (F.col("score") >= threshold).alias("toxic"))


def drop_toxic(
    docs: DataFrame, model: Model, text_column: str = "text", lang_column: str = "lang"
) -> DataFrame:
    """``docs`` with all its columns, without the rows whose score reaches the threshold.

    Rows are judged as ``score_toxicity`` does, where they are read: nothing is
    joined or shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = Scorer(model)
        common = model.thresholds.get(None, 0.5)
        for batch in batches:
            for part in slices(batch, TEXT_BYTES, text_column):
                limits = [
                    model.thresholds.get(lang, common)
                    for lang in (part.column(lang_column).to_pylist()
                                 if lang_column in part.schema.names else [None] * part.num_rows)
                ]
                keep = scorer.scores(as_bytes(part.column(text_column))) < np.array(limits)
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def _with_language(docs: DataFrame, ident: str, text: str, lang: str) -> DataFrame:
    found = column(lang) if lang in docs.columns else F.lit(None)
    return docs.select(column(ident).cast("long").alias("id"),
                       column(text).cast("string").alias("text"), found.cast("string").alias("lang"))


def _by_language(thresholds: Mapping[str | None, float]) -> Column:
    common = F.lit(thresholds.get(None, 0.5))
    own = {lang: value for lang, value in thresholds.items() if lang is not None}
    if not own:
        return common
    table = F.create_map(*(F.lit(one) for pair in own.items() for one in pair))
    return F.coalesce(F.try_element_at(table, F.col("lang")), common)
