"""The cache demonstration job: settings file → session settings → five cache cycles.

    python -m tidemark.plans.cache_demo settings.yaml GIT_ROOT=/repos/one

Each name=value fills the placeholder of that name; line ends in the value are removed.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.render import render, without_newlines
from tidemark.operators.cache import cache_cycle
from tidemark.operators.documents import read_yaml
from tidemark.operators.settings_record import read_settings
from tidemark.session import configure, fresh_name
from tidemark.sources.files import read_whole_text, split_documents
from tidemark.sources.ranges import range_rows, register_view

# Rows of the demonstration table and rounds.
DEMO_ROWS = 5000
DEMO_ROUNDS = 5


def settings_from_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    variables: Mapping[str, Column | str],
    driver: str | None = None,
    several: bool = False,
) -> DataFrame:
    """(``path``, ``settings``) of YAML settings files, placeholders filled.

    ``several`` says that a file may hold many documents.
    """
    files = read_whole_text(spark, paths)
    if several:
        files = split_documents(files)
    rendered = files.select("path", render(F.col("content"), variables).alias("content"))
    record = read_settings(read_yaml(rendered, "content"), "doc", driver=driver)
    return record.select("path", "settings")


def cache_demo(spark: SparkSession) -> DataFrame:
    """Cache, count and uncache a range under a view, round after round."""
    view = fresh_name("test")
    register_view(range_rows(spark, DEMO_ROWS), view)
    try:
        return cache_cycle(spark, [view], DEMO_ROUNDS)
    finally:
        spark.catalog.dropTempView(view)


def main(arguments: Sequence[str]) -> int:
    if not arguments:
        print("give the path of a settings file", file=sys.stderr)
        return 1
    path, *given = arguments
    if not all("=" in one for one in given):
        print("give placeholders as name=value", file=sys.stderr)
        return 1
    values = {name: without_newlines(F.lit(value))
              for name, _, value in (one.partition("=") for one in given)}
    spark = configure(SparkSession.builder.getOrCreate())
    try:
        settings_from_files(spark, path, values).show(truncate=False)
        cache_demo(spark).show(truncate=False)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
