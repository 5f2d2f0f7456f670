"""Parquet clustered by a space-filling curve, and what a reader can skip of it by the footers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import fresh_name
from tidemark.sources.files import write_parquet

# Cells a column is cut into, as a power of two, and the rank error of their sampled bounds.
BITS = 6
QUANTILE_ACCURACY = 10_000
ROWS_PER_FILE = 1_000_000


def _number(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    if kind == "timestamp":
        return F.unix_micros(name)
    if kind == "timestamp_ntz":
        return F.unix_micros(F.to_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone()))
    return F.col(name)


def _cell(value: Column, bounds: list) -> Column:
    """How many of the bounds ``value`` has passed; none if it is null."""
    if not bounds:
        return F.lit(0)
    passed = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound < value))
    return F.when(value.isNull(), 0).otherwise(passed)


def curve_key(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> Column:
    """The place of a row on the Z-order curve over ``columns``, numbers or times.

    Each column is cut into at most 2^bits cells of about equally many rows, by
    bounds from one aggregation of sampled quantiles; the bits of the cells'
    numbers are then interleaved. A null is in the first cell. Skewed columns
    have equal bounds, which fall together.
    """
    shares = [number / (1 << bits) for number in range(1, 1 << bits)]
    bounds = df.agg(*[
        F.percentile_approx(_number(df, name), shares, QUANTILE_ACCURACY).alias(str(at))
        for at, name in enumerate(columns)
    ]).first()
    key = F.lit(0).cast("long")
    for at, name in enumerate(columns):
        cell = _cell(_number(df, name), sorted(set(bounds[str(at)] or [])))
        for bit in range(bits):
            own = F.shiftright(cell, bit).bitwiseAND(F.lit(1)).cast("long")
            key = key.bitwiseOR(F.shiftleft(own, bit * len(columns) + at))
    return key


def write_clustered(
    df: DataFrame,
    columns: Sequence[str],
    path: str,
    rows_per_file: int = ROWS_PER_FILE,
    bits: int = BITS,
    mode: str = "errorifexists",
) -> None:
    """Write parquet whose files, and row groups, each cover few values of all of ``columns``.

    Rows are dealt to files by ranges of ``curve_key``; rows of one place by
    the columns themselves, so a cell that holds much of the table is spread
    too. A filter on any of the columns, or on several, then skips most files.
    One shuffle; the number of files follows from the rows.
    """
    place = fresh_name("place")
    files = max(1, -(-df.count() // rows_per_file))
    dealt = df.withColumn(place, curve_key(df, columns, bits)).repartitionByRange(files, place, *columns)
    write_parquet(dealt.sortWithinPartitions(place, *columns).drop(place), path, mode)


def row_groups(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The row groups of a parquet folder, from the files' footers.

    ``file``, ``row_group``, ``rows``, and for each column ``<name>_low`` and
    ``<name>_high`` (doubles; microseconds for times; null without statistics).
    Footers are read by tasks, a file each; no rows are.
    """
    files = spark.createDataFrame([(name,) for name in spark.read.parquet(path).inputFiles()], "file string")
    names = list(columns)
    bounds = ", ".join(f"`{name}_low` double, `{name}_high` double" for name in names)

    def footers(batches):
        import datetime

        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet

        def number(value):
            if not isinstance(value, datetime.datetime):
                return float(value)
            zone = value.tzinfo or datetime.timezone.utc
            since = value.replace(tzinfo=zone) - datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
            return float(since // datetime.timedelta(microseconds=1))

        for batch in batches:
            rows = []
            for uri in batch.column("file").to_pylist():
                system, at = pyarrow.fs.FileSystem.from_uri(uri)
                with system.open_input_file(at) as held:
                    meta = pyarrow.parquet.ParquetFile(held).metadata
                for group in range(meta.num_row_groups):
                    found = meta.row_group(group)
                    of = {found.column(i).path_in_schema: found.column(i).statistics
                          for i in range(found.num_columns)}
                    row = [uri, group, found.num_rows]
                    for name in names:
                        known = of[name] if of[name] is not None and of[name].has_min_max else None
                        row += [None, None] if known is None else [number(known.min), number(known.max)]
                    rows.append(row)
            kinds = [pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * (2 * len(names))]
            heads = ["file", "row_group", "rows", *[f"{n}_{end}" for n in names for end in ("low", "high")]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)], names=heads)

    return files.repartition(max(1, min(spark.sparkContext.defaultParallelism, files.count()))).mapInArrow(
        footers, f"file string, row_group int, rows long, {bounds}")


def skipping(groups: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """``row_groups`` with ``kept``: whether a reader of rows within ``ranges`` (both ends
    included) has to open the group. One without statistics is always kept."""
    kept = F.lit(True)
    for name, (low, high) in ranges.items():
        kept = kept & F.coalesce((F.col(f"{name}_low") <= high) & (F.col(f"{name}_high") >= low), F.lit(True))
    return groups.withColumn("kept", kept)
