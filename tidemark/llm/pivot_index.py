"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest reference points, in order. Inverted
lists by reference point bring together vectors that share one; pairs that share
at least ``SHARED`` are verified by their cosine. A pair is verified in the list
of the smallest point it shares, so links can be counted without being written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, kept
from tidemark.llm.components import components, pair_tasks

COSINE = 0.95
PIVOTS = 1024
NEAREST = 6
SHARED = 2
SAMPLE = 4096
APART = 0.6
LIST = 768
POINTS_AT_ONCE = 4096


def directions(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision."""
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def pick_pivots(sample: np.ndarray, most: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Sample vectors of which no two have a cosine of ``apart`` or more.

    So a crowded place gets one point, and its vectors are told apart from
    others by the points around it rather than shuffled among points inside it.
    """
    rows = directions(sample)
    found = np.empty((min(most, len(rows)), rows.shape[1]))
    count = 0
    for row in rows:
        if count == len(found):
            break
        if not count or (found[:count] @ row).max() < apart:
            found[count] = row
            count += 1
    return found[:count]


def nearest(rows: np.ndarray, pivots: np.ndarray, most: int = NEAREST) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    most = min(most, len(pivots))
    near = rows @ pivots.T
    top = np.argpartition(-near, most - 1, axis=1)[:, :most]
    order = np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable")
    return np.take_along_axis(top, order, 1).astype(np.int32)


def candidates(first: np.ndarray, second: np.ndarray, pivot: int, shared: int) -> np.ndarray:
    """Pairs that share at least ``shared`` pivots, of which ``pivot`` is the smallest."""
    counts = np.zeros((len(first), len(second)), np.uint8)
    taken = np.zeros(counts.shape, bool)
    left, right = _holders(first), _holders(second)
    for one in left.keys() & right.keys():
        at = np.ix_(left[one], right[one])
        if one < pivot:
            taken[at] = True
        else:
            counts[at] += 1
    return (counts >= shared) & ~taken


def _holders(lists: np.ndarray) -> dict[int, np.ndarray]:
    """The rows that hold each pivot."""
    flat = lists.ravel()
    order = np.argsort(flat, kind="stable")
    names, starts = np.unique(flat[order], return_index=True)
    rows = order // lists.shape[1]
    return dict(zip(names.tolist(), np.split(rows, starts[1:])))


def local_roots(links: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest class linked, over any number of links, to each row's and each column's."""
    most = np.iinfo(np.int64).max
    roots, others = first.copy(), second.copy()
    while True:
        up = np.minimum(roots, np.where(links, others[None, :], most).min(1, initial=most))
        down = np.minimum(others, np.where(links, up[:, None], most).min(0, initial=most))
        if (up == roots).all() and (down == others).all():
            return roots, others
        roots, others = up, down


def _usable(vector: str) -> Column:
    """Not null or zero, and without null, infinite or not-a-number components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def link_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    cosine: float = COSINE,
) -> DataFrame:
    """One row per input row: ``id``, ``n_links``, ``component_id``, ``kept``.

    Links are pairs of a cosine of at least ``cosine``, in double precision.
    Equal vectors are one class: they are linked with each other without being
    compared, and count by their number. Vectors that are null, zero, empty, or
    hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Repeated rows are vectors of their own. A null id is
    counted, but names no component; a component without any id is null. An empty
    table gives an empty result. Only the two named columns are read.

    Pivots are picked from about ``SAMPLE`` vectors, chosen by hash; all vectors
    are indexed. A list of many vectors is cut in pieces of ``LIST``, each two of
    which are a task. Pairs inside crowded lists are verified but never written:
    tasks give counts, and one root for each class.
    """
    source = vectors.select(
        column(id_column).cast("long").alias("id"), column(vector_column).alias("vector"))
    good = source.where(_usable("vector"))
    classes = kept(
        good.groupBy("vector").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("lowest"))
        .withColumn("class", F.monotonically_increasing_id()), "classes")
    linked = kept(_verify(_postings(classes), cosine), "links")
    counts = linked.groupBy("class").agg(F.sum("n").alias("others"))
    roots = components(linked.where(F.col("class") > F.col("root")).select(
        F.col("class").alias("high"), F.col("root").alias("low")))
    named = (
        classes.join(counts, "class", "left")
        .join(roots, F.col("class") == F.col("node"), "left")
        .select("vector", "lowest", F.coalesce("root", "class").alias("root"),
                (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    )
    lowest = named.groupBy("root").agg(F.min("lowest").alias("component_id"))
    full = named.join(lowest, "root").select("vector", "n_links", "component_id")
    alone = source.where(~_usable("vector")).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.join(full, "vector").select("id", "n_links", "component_id").union(alone).select(
        "id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _postings(classes: DataFrame) -> DataFrame:
    """``class``, ``members``, the vector's bytes, its pivots, and one of them as ``pivot``."""
    spark = classes.sparkSession
    total = classes.count()
    part = min(1.0, SAMPLE / max(1, total))
    drawn = classes.where(
        F.pmod(F.xxhash64("vector", F.lit(3)), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)) + 1)
    ).select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for row in drawn:
        by_length.setdefault(len(row["vector"]), []).append(row["vector"])
    shared = spark.sparkContext.broadcast(
        {length: pick_pivots(np.array(rows)) for length, rows in by_length.items()})
    kind = "<f8" if dict(classes.dtypes)["vector"] == "array<double>" else "<f4"

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = dict(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, POINTS_AT_ONCE):
                part = batch.slice(start, POINTS_AT_ONCE)
                lists = part.column("vector")
                lengths = np.diff(lists.offsets.to_numpy())
                values = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lengths)
                for length in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == length)
                    rows = values[(ends[own] - length)[:, None] + np.arange(length)]
                    if length not in pivots:  # too rare to be in the sample
                        pivots[length] = pick_pivots(
                            np.random.default_rng(length).normal(size=(SAMPLE, length)))
                    near = nearest(directions(rows), pivots[length])
                    raw = np.ascontiguousarray(rows.astype(kind))
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([
                        part.column("class").take(take), part.column("members").take(take),
                        pa.array(np.full(len(own), length, np.int32)),
                        pa.array([one.tobytes() for one in raw], pa.binary()),
                        pa.array(list(near), pa.list_(pa.int32())),
                    ], names=["class", "members", "length", "raw", "pivots"])

    found = classes.select("class", "members", "vector").mapInArrow(
        described, "class long, members long, length int, raw binary, pivots array<int>")
    return kept(found, "pivots").withColumn("double", F.lit(kind == "<f8")).withColumn(
        "pivot", F.explode("pivots"))


def _verify(postings: DataFrame, cosine: float) -> DataFrame:
    """``class``, ``n`` (rows linked with it in one task), ``root`` (the smallest class it meets there)."""
    tasks = pair_tasks(postings, ["length", "pivot"], "class", LIST)

    def verified(key: tuple, table: pa.Table) -> pa.Table:
        length, pivot = key[0].as_py(), key[1].as_py()
        raw = table.column("raw").to_pylist()
        kind = "<f8" if table.column("double")[0].as_py() else "<f4"
        rows = directions(np.frombuffer(b"".join(raw), kind).reshape(len(raw), length))
        classes, members = (table.column(name).to_numpy() for name in ("class", "members"))
        lists = np.array(table.column("pivots").to_pylist(), np.int32).reshape(len(raw), -1)
        second = table.column("second").to_numpy()
        within = key[2].as_py() == key[3].as_py()
        a = np.flatnonzero(~second)
        b = a if within else np.flatnonzero(second)
        links = candidates(lists[a], lists[b], pivot, min(SHARED, lists.shape[1]))
        links &= rows[a] @ rows[b].T >= cosine
        if within:
            np.fill_diagonal(links, False)
        roots, others = local_roots(links, classes[a], classes[b])
        parts = [(classes[a], links @ members[b], np.minimum(roots, others) if within else roots)]
        if not within:
            parts.append((classes[b], members[a] @ links, others))
        own, n, root = map(np.concatenate, zip(*parts))
        some = n > 0
        return pa.table({"class": own[some], "n": n[some].astype(np.int64), "root": root[some]})

    return tasks.groupBy("length", "pivot", "task_a", "task_b").applyInArrow(
        verified, "class long, n long, root long")
