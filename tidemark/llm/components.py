"""Connected components by alternating large and small stars, and pair tasks for hot groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import kept


def pair_tasks(
    members: DataFrame, keys: Sequence[str], spread_by: str, limit: int, weight: str | None = None
) -> DataFrame:
    """Deal the pairs of each group out to tasks of at most about ``2 * limit`` members.

    A group of up to ``limit`` members is one task. A larger one is cut by a hash
    into pieces, and each two pieces (and each piece with itself) are a task, so
    that every pair of members meets in at least one task and no task grows
    with the group. Adds ``task_a``, ``task_b`` and ``second`` (the member is of
    the second piece). Groups of one member are kept. With ``weight``, a column,
    its sum counts in place of the members.
    """
    sizes = (
        members.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("size"))
        .where(F.col("size") > limit)
        .select(*keys, F.ceil(F.col("size") / limit).cast("int").alias("pieces"))
    )
    cut = (
        members.join(sizes, list(keys), "left")
        .withColumn("pieces", F.coalesce("pieces", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(spread_by), F.col("pieces")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    )
    return cut.select(
        *members.columns,
        F.least("own", "other").alias("task_a"),
        F.greatest("own", "other").alias("task_b"),
        (F.col("own") > F.col("other")).alias("second"),
    )


def spanning_edges(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smallest of its component) that connect what the given pairs connect."""
    nodes, places = np.unique(np.concatenate((left, right)), return_inverse=True)
    a, b = places[:left.size], places[left.size:]
    label = np.arange(nodes.size)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    other = np.flatnonzero(label != np.arange(nodes.size))
    return nodes[other], nodes[label[other]]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
    least = both.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    return (
        edges.join(least, F.col("low") == F.col("node"))
        .select("high", F.least("low", "least").alias("low")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("least"))
    moved = (
        edges.join(least, F.col("high") == F.col("node"))
        .where(F.col("low") != F.col("least"))
        .select(F.col("low").alias("high"), F.col("least").alias("low"))
    )
    return moved.union(least.select(F.col("node").alias("high"), F.col("least").alias("low"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    rows, nodes = edges.agg(F.count(F.lit(1)), F.countDistinct("high")).first()
    if rows != nodes:
        return False
    return edges.join(edges.select(F.col("high").alias("low")), "low", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for every node but the smallest of each component.

    ``edges`` has ``high`` and ``low`` (long), high > low; repeats are allowed.
    Each round is written to the shared folder; their number grows with the
    logarithm of the largest component. Nothing but two counts comes to the
    driver.
    """
    edges = kept(edges.select("high", "low").distinct(), "edges")
    while not _is_stars(edges):
        edges = kept(_small_star(_large_star(edges)), "edges")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
