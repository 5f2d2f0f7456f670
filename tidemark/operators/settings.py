"""Settings held as tables: restriction, layered merge, name filter, placeholder join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.render import render
from tidemark.operators.joins import BROADCAST_LIMIT_BYTES, join_measured, row_bytes


def restrict_keys(settings: DataFrame, *key_sources: DataFrame) -> DataFrame:
    """Rows of ``settings`` whose (scope, key) occurs in one of ``key_sources``.

    A semi join needs no distinct keys, so each side is shuffled once. That shuffle
    is the join's own, which lets adaptive execution split a partition that a hot
    key of ``settings`` fills.
    """
    keys = reduce(DataFrame.unionByName, [source.select("scope", "key") for source in key_sources])
    return settings.join(keys, ["scope", "key"], "left_semi")


def merge_layers(layers: Sequence[DataFrame]) -> DataFrame:
    """The value of the strongest layer (lowest ``priority``) per scope and key.

    A layer holds a key once; should it hold it twice, the smaller value wins,
    so that a retried task gives the same answer.
    """
    rows = reduce(
        DataFrame.unionByName,
        [layer.select("scope", "key", "priority", "value") for layer in layers],
    )
    return rows.groupBy("scope", "key").agg(
        F.min_by("value", F.struct("priority", "value")).alias("value")
    )


# Precedence of the three layers, strongest first.
INJECTED, SUBMITTED, DEFAULT = 1, 2, 3


def merge_settings(injected: DataFrame, submitted: DataFrame, default: DataFrame) -> DataFrame:
    """injected > submitted > default, for keys that injected or default name.

    Submitted keys that neither names are left out. The restriction rides on
    the merge's own aggregation, so there is one shuffle of partially merged
    rows and no join; ``restrict_keys`` is the same rule as a join.
    """
    rows = reduce(
        DataFrame.unionByName,
        [
            layer.select("scope", "key", "value", F.lit(priority).alias("priority"))
            for layer, priority in (
                (injected, INJECTED), (submitted, SUBMITTED), (default, DEFAULT),
            )
        ],
    )
    merged = rows.groupBy("scope", "key").agg(
        F.min_by("value", F.struct("priority", "value")).alias("value"),
        F.bool_or(F.col("priority") != SUBMITTED).alias("__named"),
    )
    return merged.where("__named").drop("__named")


def filter_names(
    df: DataFrame, column: str, match: Sequence[str] = (), regex: str | None = None
) -> DataFrame:
    """Rows whose name is in ``match`` or holds a match of ``regex``.

    Works on batch and streaming frames. A plain name list reaches the parquet
    scan as a pushed filter.
    """
    if not match and regex is None:
        raise ValueError("give names, a regex, or both")
    name = F.col(column)
    kept: list[Column] = []
    if match:
        kept.append(name.isin(list(match)))
    if regex is not None:
        kept.append(name.rlike(regex))
    return df.where(reduce(Column.__or__, kept))


def render_from_table(
    df: DataFrame,
    column: str,
    variables: DataFrame,
    names: Sequence[str],
    into: str | None = None,
    extra: Mapping[str, Column | str] | None = None,
    limit_bytes: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Fill placeholders from rows (``scope``, ``name``, ``value``) of the document's scope.

    A scope holds a name once, or the call is refused; a name it lacks prints
    "null". ``extra`` holds placeholders that need no table. The rows become one
    row per scope, which is measured, and checked for repeats, by one job and
    joined once, however many names there are.
    """
    found = [f"__value{number}" for number in range(len(names))]
    of_name = [F.when(F.col("name") == name, F.struct("value")) for name in names]
    wide = (
        variables.where(F.col("name").isin(list(names)) & F.col("scope").isNotNull())
        .groupBy("scope").agg(
            *[F.max(one)["value"].alias(into_name) for one, into_name in zip(of_name, found)],
            F.greatest(*[F.count(one) for one in of_name], F.lit(0)).alias("__repeats"))
    )
    size, repeats = wide.agg(F.sum(row_bytes(wide)), F.max("__repeats")).first()
    if (repeats or 0) > 1:
        raise ValueError("the variables have several rows for one scope and name")
    joined = join_measured(df, wide.drop("__repeats"), "scope", size or 0, limit_bytes)
    values = {name: F.col(one) for name, one in zip(names, found)}
    return joined.withColumn(
        into or column, render(F.col(column), {**values, **(extra or {})})).drop(*found)
