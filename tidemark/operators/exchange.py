"""Values from the driver to the executors, and metrics back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def with_parameters(df: DataFrame, parameters: Mapping[str, object]) -> DataFrame:
    """Add driver-side values as columns; they travel inside the plan."""
    return df.withColumns({name: F.lit(value) for name, value in parameters.items()})


def with_parameter_from(df: DataFrame, parameters: DataFrame, column: str, into: str) -> DataFrame:
    """Add the single value of ``parameters`` as a column of every row.

    A scalar subquery: Spark runs it once, ships the value with the tasks, and
    refuses a table of more than one row.
    """
    return df.withColumn(into, parameters.select(column).scalar())


def observed(df: DataFrame, name: str, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """Have the next action on the returned frame report ``metrics`` to the driver.

    Read ``Observation.get`` only after that action. Placed right before a
    write, each partition reports once, with its finished task.
    """
    observation = Observation(name)
    return df.observe(observation, *[c.alias(n) for n, c in metrics.items()]), observation
