"""Clustered files and bucketed tables."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.bucketed_settings import merge_bucketed, restrict_bucketed
from tidemark.operators.settings import merge_settings, restrict_keys
from tidemark.session import fresh_name, scratch_path
from tidemark.sources.clustered import curve_key, row_groups, skipping, write_clustered
from tidemark.sources.tables import drop_table, save_bucketed


def test_curve_interleaves_the_cells(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"))
    keys = df.withColumn("key", curve_key(df, ["x", "y"], bits=3)).collect()

    def place(x, y):
        return sum(((x >> bit) & 1) << 2 * bit | ((y >> bit) & 1) << 2 * bit + 1 for bit in range(3))

    assert {(r["x"], r["y"]): r["key"] for r in keys} == {(x, y): place(x, y) for x in range(8) for y in range(8)}


def test_clustered_files_skip_on_each_column(spark):
    path = scratch_path(spark, "clustered files")
    df = spark.range(20_000).select(
        "id", F.timestamp_seconds(F.col("id") * 60).alias("t"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("u"),
        F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(7).alias("hot")).repartition(4)
    write_clustered(df, ["t", "u"], path, rows_per_file=200)
    assert sorted(spark.read.parquet(path).collect()) == sorted(df.collect())
    groups = row_groups(spark, path, ["t", "u", "id"])
    assert groups.agg(F.sum("rows")).first()[0] == 20_000 and groups.count() >= 100
    day = 86_400 * 1_000_000
    for ranges, most in (({"t": (0, day)}, 0.35), ({"u": (0, 24)}, 0.35), ({"t": (0, day), "u": (0, 24)}, 0.08)):
        found = skipping(groups, ranges)
        share = found.agg(F.avg(F.col("kept").cast("int"))).first()[0]
        assert 0 < share < most
        needed = df.where(" AND ".join(
            f"{'unix_micros(t)' if name == 't' else name} BETWEEN {low} AND {high}" for name, (low, high) in ranges.items()))
        # No group that is skipped holds such a row.
        kept_files = {r["file"] for r in found.where("kept").collect()}
        inside = spark.read.parquet(path).select("*", F.input_file_name().alias("file")).join(needed.select("id"), "id")
        assert {r["file"] for r in inside.select("file").distinct().collect()} <= kept_files
    # A value that a third of the rows share is spread over files.
    hot = scratch_path(spark, "hot")
    write_clustered(df, ["hot", "u"], hot, rows_per_file=500)
    assert row_groups(spark, hot, ["hot"]).agg(F.max("rows")).first()[0] < 3000


def test_clustering_of_nulls_and_no_rows(spark):
    schema = "a long, b timestamp"
    for rows in ([], [(None, None)] * 5, [(1, None), (None, None), (1, None)]):
        path = scratch_path(spark, "odd")
        write_clustered(spark.createDataFrame(rows, schema), ["a", "b"], path)
        assert spark.read.schema(schema).parquet(path).count() == len(rows)
        groups = row_groups(spark, path, ["a", "b"])
        assert (groups.agg(F.sum("rows")).first()[0] or 0) == len(rows)


@pytest.fixture
def layers(spark):
    rng = random.Random(4)
    frames, tables, names = [], [], []
    for number in range(3):
        rows = {(str(rng.randrange(9)), f"k{rng.randrange(40)}"): rng.choice(["a", "b", None, ""]) for _ in range(150)}
        rows = [(*key, value) for key, value in rows.items()] + [("0", "k1", "z"), ("0", "k1", "y")]
        frames.append(spark.createDataFrame(rows, "scope string, key string, value string"))
        names.append(fresh_name("layer"))
        tables.append(save_bucketed(frames[-1], names[-1], ["scope", "key"], 3, scratch_path(spark, "layer")))
    yield frames, tables
    for name in names:
        drop_table(spark, name)


def test_bucketed_settings_shuffle_nothing(spark, layers, capsys):
    (injected, submitted, default), tables = layers
    pairs = [
        (merge_bucketed(*tables), merge_settings(injected, submitted, default)),
        (restrict_bucketed(tables[1], tables[0], tables[2]), restrict_keys(submitted, injected, default)),
    ]
    for got, want in pairs:
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
        capsys.readouterr()
        got.explain()
        plan = capsys.readouterr().out
        assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_buckets_refuse_rows_without_a_key(spark):
    rows = spark.createDataFrame([("a", None, "v")], "scope string, key string, value string")
    with pytest.raises(Exception, match="has no scope"):
        save_bucketed(rows, fresh_name("bad"), ["scope", "key"], 2, scratch_path(spark, "bad"))
