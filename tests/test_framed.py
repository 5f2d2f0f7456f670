"""Framed files against the texts that went in."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.sources import framed
from tidemark.sources.framed import read_framed, write_framed

TEXTS = [None, "", "\n", "---", "a\r\nb\r\n", "---\n---\n", "ü 漢 \x00 \x1c", " ", "a: 1", "x" * 5000]


def back(spark, path):
    return sorted(((r["key"], r["content"]) for r in read_framed(spark, path).collect()), key=str)


def test_every_text_comes_back(spark):
    path = scratch_path(spark, "framed texts")
    rows = [(str(i), text) for i, text in enumerate(TEXTS)] + [(None, None), ("3", "---"), ("", "")]
    df = spark.createDataFrame(rows, "key string, text string")
    write_framed(df.repartition(3), "text", path, key="key")
    assert back(spark, path) == sorted(rows, key=str)
    # A second write adds, and a replacing one leaves only its own.
    write_framed(df.limit(2), "text", path)
    assert len(back(spark, path)) == len(rows) + 2
    write_framed(df.where("key = '4'"), "text", path, mode="overwrite")
    assert back(spark, path) == [(None, "a\r\nb\r\n")]
    assert len([n for n in os.listdir(path.removeprefix("file:")) if n.endswith(".frames")]) >= 1


def test_ranges_of_bytes(spark, monkeypatch):
    monkeypatch.setattr(framed, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(framed, "BATCH_BYTES", 300)
    path = scratch_path(spark, "blocks")
    df = spark.range(500).select(F.col("id").alias("k"), F.repeat(F.lit("é"), F.pmod("id", F.lit(90)).cast("int")).alias("t"))
    write_framed(df.coalesce(2), "t", path, key="k")
    read = read_framed(spark, path)
    assert read.rdd.getNumPartitions() > 40
    assert sorted((int(r["key"]), r["content"]) for r in read.collect()) == [tuple(r) for r in df.collect()]


def test_a_text_of_100_mb(spark):
    path = scratch_path(spark, "long")
    df = spark.range(3).select(F.col("id").alias("k"), F.repeat(F.lit("0123456789abcde\n"), F.when(
        F.col("id") == 1, 6_250_000).otherwise(2).cast("int")).alias("t"))
    write_framed(df.coalesce(1), "t", path, key="k")
    got = read_framed(spark, path).select("key", F.length("content").alias("n"), F.xxhash64("content").alias("h"))
    want = df.select(F.col("k").cast("string").alias("key"), F.length("t").alias("n"), F.xxhash64("t").alias("h"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_no_rows_and_failed_writes(spark):
    path = scratch_path(spark, "none")
    write_framed(spark.createDataFrame([], "t string"), "t", path)
    assert back(spark, path) == []
    bad = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("stop"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="stop"):
        write_framed(bad, "t", path)
    assert back(spark, path) == []
