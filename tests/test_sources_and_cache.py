"""Sources, sinks, catalog, caches, and exchange with executors."""

import glob
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators.cache import cache_cycle, cache_table, count_rows, uncache_tables
from tidemark.operators.exchange import observed, with_parameter_from, with_parameters
from tidemark.session import (
    PARQUET_TIMESTAMP_SETTINGS,
    STATE_STORE_PROVIDER,
    configure,
    fresh_name,
    scratch_path,
    session_conf,
)
from tidemark import session as session_module
from tidemark.sources import files as files_module
from tidemark.sources.files import (
    read_parquet,
    read_whole_text,
    split_documents,
    write_documents,
    write_parquet,
)
from tidemark.sources.ranges import range_rows, register_view
from tidemark.sources.tables import drop_table, save_table


def timed(spark, rows=20_000):
    return spark.range(rows).select(
        "id", F.timestamp_seconds(F.col("id") * 60).alias("ts")
    ).repartition(3)


def footer(path):
    [first, *_] = sorted(glob.glob(f"{path}/*.parquet"))
    return pq.ParquetFile(first)


def test_written_timestamps_have_statistics(spark):
    good, plain = scratch_path(spark, "good"), scratch_path(spark, "plain")
    write_parquet(timed(spark), good, sort_within=["ts"])
    with session_conf(spark, {"spark.sql.parquet.outputTimestampType": "INT96"}):
        timed(spark).write.parquet(plain)
    column = footer(good).metadata.row_group(0).column(1)
    assert column.physical_type == "INT64" and column.statistics.has_min_max
    column = footer(plain).metadata.row_group(0).column(1)
    assert column.physical_type == "INT96"
    assert not (column.statistics and column.statistics.has_min_max)
    for path in (good, plain):
        assert spark.read.parquet(path).orderBy("id").collect() == timed(spark).orderBy("id").collect()


def test_sorted_files_let_a_reader_skip_row_groups(spark):
    path = scratch_path(spark, "groups")
    with session_conf(spark, {"parquet.block.size": "20000"}):
        write_parquet(timed(spark).coalesce(1), path, sort_within=["ts"])
    meta = footer(path).metadata
    assert meta.num_row_groups > 1
    ranges = [
        (meta.row_group(i).column(1).statistics.min, meta.row_group(i).column(1).statistics.max)
        for i in range(meta.num_row_groups)
    ]
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_timestamp_filter_reaches_the_scan(spark, capsys):
    path = scratch_path(spark, "pushed")
    write_parquet(timed(spark, 100), path)
    spark.read.parquet(path).where(F.col("ts") >= datetime(1970, 1, 1, 1)).select("id").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_write_leaves_the_session_as_it_was(spark):
    before = {k: spark.conf.get(k) for k in PARQUET_TIMESTAMP_SETTINGS}
    write_parquet(timed(spark, 10), scratch_path(spark, "settings"))
    assert {k: spark.conf.get(k) for k in PARQUET_TIMESTAMP_SETTINGS} == before
    with pytest.raises(ZeroDivisionError):
        with session_conf(spark, {"spark.sql.shuffle.partitions": "9"}):
            1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_configure(spark):
    keys = [*PARQUET_TIMESTAMP_SETTINGS, "spark.sql.streaming.stateStore.providerClass"]
    with session_conf(spark, {k: spark.conf.get(k) for k in keys}):
        assert configure(spark) is spark
        assert spark.conf.get("spark.sql.parquet.outputTimestampType") == "TIMESTAMP_MICROS"
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == STATE_STORE_PROVIDER


def test_whole_text(spark):
    path = scratch_path(spark, "texts")
    spark.createDataFrame([("a\nb\r\n\nü",), ("",)], "value string").repartition(2).write.option(
        "maxRecordsPerFile", 1
    ).text(path)
    rows = read_whole_text(spark, path).collect()
    assert {r["content"] for r in rows} == {"a\nb\r\n\nü\n", "\n"}
    assert all(r["path"].startswith("file:") for r in rows)
    one = read_whole_text(spark, [rows[0]["path"], rows[1]["path"]])
    assert one.count() == 2


def test_documents_share_files(spark):
    path = scratch_path(spark, "shared")
    texts = [f"a: {n}\nb: ---\n--- c" for n in range(95)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    write_documents(df, "t", path, per_file=20)
    files = read_whole_text(spark, path)
    assert files.count() == 6
    assert sorted(r["content"] for r in split_documents(files).collect()) == sorted(f"{t}\n" for t in texts[:-1])
    with pytest.raises(PySparkException, match="holds a line"):
        write_documents(spark.createDataFrame([("a\n---\nb",)], "t string"), "t", scratch_path(spark, "refused"))


def test_spread_deals_out_small_tables_only(spark, monkeypatch):
    path = scratch_path(spark, "spread")
    spark.range(1000).coalesce(1).write.parquet(path)
    assert read_parquet(spark, path).rdd.getNumPartitions() == 1
    assert read_parquet(spark, path, spread=True).rdd.getNumPartitions() == 8
    monkeypatch.setattr(files_module, "SPREAD_BELOW_BYTES", 100)
    assert read_parquet(spark, path, spread=True).rdd.getNumPartitions() == 1


def test_scratch_is_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session_module, "shared_root", lambda spark: str(tmp_path))
    spark.range(3).write.parquet(session_module.scratch_path(spark, "one"))
    (tmp_path / "of another application").mkdir()
    assert len(list(tmp_path.iterdir())) == 2
    session_module.clear_scratch(spark)
    assert [one.name for one in tmp_path.iterdir()] == ["of another application"]


def test_tables(spark):
    name = fresh_name("saved")
    try:
        table = save_table(timed(spark, 50), name, path=scratch_path(spark, "table"))
        assert table.count() == 50 and spark.table(name).schema == table.schema
        with pytest.raises(PySparkException):
            save_table(timed(spark, 50), name)
        assert save_table(timed(spark, 20), name, mode="overwrite",
                          path=scratch_path(spark, "table")).count() == 20
    finally:
        drop_table(spark, name)
    assert not spark.catalog.tableExists(name)
    drop_table(spark, name)


def test_cache_lifecycle(spark, capsys):
    view = fresh_name("numbers")
    df = register_view(range_rows(spark, 5000), view)
    try:
        cache_table(spark, view)
        assert spark.catalog.isCached(view)
        assert count_rows(spark, view) == 5000 and df.count() == 5000
        df.explain()
        assert "In-memory table" in capsys.readouterr().out
        rows = uncache_tables(spark, [view, view, "no_such_table", f"default.{view}"]).collect()
        assert [(r["table"], r["status"], r["message"]) for r in rows] == [
            (view, 200, f"Successfully uncached table: {view}"),
            (view, 200, f"Successfully uncached table: {view}"),
            ("no_such_table", 404, "Table not found: no_such_table"),
            (f"default.{view}", 404, f"Table not found: default.{view}"),
        ]
        assert not spark.catalog.isCached(view)
        cycle = cache_cycle(spark, [view, "no_such_table"]).collect()
        assert [(r["round"], r["rows"], r["status"]) for r in cycle] == [
            item for n in range(1, 6) for item in ((n, 5000, 200), (n, None, 404))
        ]
        assert spark.catalog.tableExists(view) and not spark.catalog.isCached(view)
    finally:
        spark.catalog.dropTempView(view)


def test_uncache_of_a_name_with_its_database(spark):
    name = fresh_name("saved")
    save_table(spark.range(5), name, path=scratch_path(spark, "table"))
    try:
        cache_table(spark, f"default.{name}")
        assert count_rows(spark, name) == 5
        assert uncache_tables(spark, [f"default.{name}"]).first()["status"] == 200
        assert not spark.catalog.isCached(name)
    finally:
        drop_table(spark, name)


def test_parameters(spark):
    parameter = spark.createDataFrame([(10,)], "v int")
    df = with_parameter_from(spark.range(3), parameter, "v", "p")
    assert [tuple(r) for r in df.collect()] == [(0, 10), (1, 10), (2, 10)]
    assert with_parameters(spark.range(1), {"a": 1, "b": "x"}).first().asDict() == {
        "id": 0, "a": 1, "b": "x",
    }
    two = spark.createDataFrame([(10,), (11,)], "v int")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        with_parameter_from(spark.range(3), two, "v", "p").collect()


def test_observed_metrics_come_with_the_write(spark):
    watched, report = observed(
        spark.range(0, 1000, 1, 6), fresh_name("r"), {"total": F.sum("id"), "n": F.count(F.lit(1))}
    )
    write_parquet(watched, scratch_path(spark, "observed"))
    assert report.get == {"total": 499500, "n": 1000}
