"""Settings rules over tables bucketed by scope and key: joins of buckets, without a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["scope", "key"]


def _single(layer: DataFrame) -> DataFrame:
    """One row a key, the smallest value, as ``merge_settings`` takes it; whether there is one."""
    return layer.groupBy(*KEYS).agg(F.min_by("value", F.struct("value")).alias("value"))


def merge_bucketed(injected: DataFrame, submitted: DataFrame, default: DataFrame) -> DataFrame:
    """``merge_settings`` over tables of ``save_bucketed`` with equal buckets by scope and key.

    An injected value always counts; of the keys that only default names, a
    submitted one does. That is an anti join and a left join, both of a bucket
    with its like, so nothing is shuffled, whatever the tables' size.
    """
    own = _single(injected)
    given = _single(submitted).select(*KEYS, F.struct("value").alias("given"))
    rest = (
        _single(default).join(own.select(*KEYS).hint("merge"), KEYS, "left_anti")
        .join(given.hint("merge"), KEYS, "left")
        .select(*KEYS, F.when(F.col("given").isNull(), F.col("value")).otherwise(F.col("given.value")).alias("value"))
    )
    return own.unionByName(rest)


def restrict_bucketed(settings: DataFrame, *key_sources: DataFrame) -> DataFrame:
    """``restrict_keys`` over tables bucketed alike: one semi join of buckets a source."""
    parts, left = [], settings
    for source in key_sources:
        keys = source.select(*KEYS).hint("merge")
        parts.append(left.join(keys, KEYS, "left_semi"))
        left = left.join(keys, KEYS, "left_anti")
    return reduce(DataFrame.unionByName, parts)
