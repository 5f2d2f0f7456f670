"""Streams against the same work in batch."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.documents import read_yaml_record
from tidemark.operators.exchange import observed
from tidemark.session import scratch_path, session_conf
from tidemark.streaming.joins import chain_within, once_per_period
from tidemark.plans.streams import CHAIN, WITHIN, chain_events_run, chain_run
from tidemark.streaming.chains import group_count, last_before
from tidemark.streaming.manifest import lay_out, stream_manifest
from tidemark.streaming.runner import FULL_STATE_ROWS, STATE_ROWS, finish, run_stream, start_stream, state_partitions
from tidemark.streaming.sources import arrange_by_time, stream_parquet
from tidemark.streaming.state import state_rows, stateful_steps

START = datetime(2024, 1, 1)


def write_batches(spark, *batches):
    """One file per batch, with modification times in that order."""
    path = scratch_path(spark, "batches").removeprefix("file:")
    os.makedirs(path)
    for number, rows in enumerate(batches):
        part = scratch_path(spark, "part").removeprefix("file:")
        spark.createDataFrame(rows, "user_id long, kind string, ts timestamp").coalesce(
            1
        ).write.parquet(part)
        [name] = [n for n in os.listdir(part) if n.endswith(".parquet")]
        target = f"{path}/batch-{number}.parquet"
        os.link(f"{part}/{name}", target)
        os.utime(target, (1_700_000_000 + number * 60,) * 2)
    return path


def hours(*steps):
    return [(user, kind, START + timedelta(hours=h)) for user, kind, h in steps]


def chain(events, delay="1 hour"):
    def step(kind, name):
        rows = events.where(F.col("kind") == kind).select("user_id", F.col("ts").alias(name))
        return once_per_period(rows, "user_id", name, "hour", delay), name

    return chain_within([step("view", "v"), step("click", "c"), step("buy", "b")],
                        "user_id", "5 HOURS")


def micros(hour):
    return int((START - datetime(1970, 1, 1)).total_seconds() + hour * 3600) * 1_000_000


def run(spark, path, files=None, delay="1 hour", **options):
    output, done = run_stream(
        chain(stream_parquet(spark, path, files_per_trigger=files), delay), "t", timeout=120, **options
    )
    rows = {tuple(r) for r in output.select("user_id", "v", "c", "b").collect()}
    return rows, output.count(), done


EVENTS = hours(
    (1, "view", 0), (1, "view", 0.5), (1, "click", 2), (1, "buy", 6),     # in time, views collapse
    (2, "view", 0), (2, "click", 6), (2, "buy", 7),                       # click too late
    (3, "click", 1), (3, "view", 2), (3, "buy", 3),                       # wrong order
    (4, "view", 1), (4, "click", 1), (4, "buy", 1),                       # all at once
)
EXPECTED = {(1, micros(0), micros(2), micros(6)), (4, micros(1), micros(1), micros(1))}


def test_chain_in_one_batch(spark):
    rows, count, _ = run(spark, write_batches(spark, EVENTS))
    assert rows == EXPECTED and count == len(EXPECTED)


def test_chain_over_batches_in_order(spark):
    ordered = sorted(EVENTS, key=lambda e: e[2])
    rows, count, done = run(spark, write_batches(spark, ordered[:5], ordered[5:9], ordered[9:]), files=1)
    assert rows == EXPECTED and count == len(EXPECTED)
    assert done.batches >= 3 and done.dropped == 0
    state = done.query.recentProgress[-1].stateOperators
    assert len(state) == 5  # three distinct steps, two joins


def test_late_rows_within_the_delay_count_and_later_ones_are_dropped(spark):
    first = hours((1, "view", 0), (1, "click", 1), (2, "view", 0), (2, "click", 1), (9, "buy", 30))
    late = hours((1, "buy", 2))
    kept, _, _ = run(spark, write_batches(spark, first, late), files=1, delay="40 hours")
    assert kept == {(1, micros(0), micros(1), micros(2))}
    advance = hours((9, "view", 30), (9, "click", 30), (9, "buy", 30))
    # Late rows are measured against the watermark of the batch before.
    later = hours((9, "view", 31), (9, "click", 40), (9, "buy", 50))
    path = write_batches(spark, first[:4], advance, later, late)
    lost, _, done = run(spark, path, files=1, on_late="report")
    assert lost == {(9, micros(30), micros(30), micros(30))} and done.dropped > 0
    with pytest.raises(RuntimeError, match="dropped"):
        run(spark, path, files=1)
    with pytest.raises(ValueError):
        run(spark, path, on_late="ignore")


def test_hot_user(spark):
    rows = [(1, kind, START + timedelta(minutes=i % 180))
            for kind in ("view", "click", "buy") for i in range(3000)]
    got, count, _ = run(spark, write_batches(spark, rows))
    assert count == len(got) == sum(1 for v in range(3) for c in range(v, 3) for _ in range(c, 3))


def test_restart_goes_on_from_the_checkpoint(spark):
    path = write_batches(spark, EVENTS[:2])
    output, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "state")
    for batch in (None, EVENTS[2:]):
        if batch:
            more = write_batches(spark, batch)
            os.link(f"{more}/batch-0.parquet", f"{path}/batch-9.parquet")
        query = start_stream(chain(stream_parquet(spark, path)), output, checkpoint, state_partitions=2)
        finish(query, 120)
    rows = {tuple(r) for r in spark.read.parquet(output).select("user_id", "v", "c", "b").collect()}
    assert rows == EXPECTED
    assert sum(p.numInputRows for p in query.recentProgress) == 3 * len(EVENTS[2:])


def test_runner_options(spark):
    before = spark.sql("SET").collect()
    rows, _, _ = run(
        spark, write_batches(spark, EVENTS),
        state_provider="org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
        retention={"minBatchesToRetain": 2, "minDeltasForSnapshot": 2, "maintenanceInterval": "10s"},
    )
    assert rows == EXPECTED
    assert spark.sql("SET").collect() == before
    with pytest.raises(KeyError):
        run(spark, write_batches(spark, EVENTS), retention={"unknown": 1})


def test_observed_metrics_over_more_batches_than_spark_remembers(spark):
    path = write_batches(spark, *[[event] for event in EVENTS])
    watched, _name = stream_parquet(spark, path, files_per_trigger=1), "watched"
    watched = watched.observe(_name, F.sum("user_id").alias("total"))
    with session_conf(spark, {"spark.sql.streaming.numRecentProgressUpdates": "2"}):
        _, done = run_stream(watched, "observed", timeout=120)
        assert len(done.query.recentProgress) <= 2 and done.batches >= len(EVENTS)
    assert done.total(_name, "total") == sum(e[0] for e in EVENTS)


def test_given_events_in_batches_by_time(spark):
    one, alone = chain_run(spark, "/root/testdata/sf0.01", 1)
    several, steps = chain_run(spark, "/root/testdata/sf0.01", 5)
    assert steps.batches > alone.batches and steps.dropped == 0
    assert steps.peak_state < alone.peak_state
    assert sorted(one.collect()) == sorted(several.collect())


@pytest.mark.parametrize("name", ["one.parquet", "a,b.parquet", "{x}.parquet", "[y]*.parquet", "z?.parquet"])
def test_files_and_folders_of_any_name(spark, name, monkeypatch):
    path = write_batches(spark, EVENTS)
    os.rename(f"{path}/batch-0.parquet", f"{path}/{name}")
    odd = f"{path}/in {name}"
    os.makedirs(odd)
    os.link(f"{path}/{name}", f"{odd}/part.parquet")
    for place in (f"{path}/{name}", odd):
        output, _ = run_stream(stream_parquet(spark, place), "names", timeout=60)
        assert output.count() == len(EVENTS)


def test_relative_and_missing_paths(spark):
    path = os.path.relpath(write_batches(spark, EVENTS))
    output, _ = run_stream(stream_parquet(spark, f"{path}/batch-0.parquet"), "relative", timeout=60)
    assert output.count() == len(EVENTS)
    with pytest.raises(FileNotFoundError):
        stream_parquet(spark, f"{path}/other.parquet")


def test_files_arranged_by_time(spark):
    path = scratch_path(spark, "arranged")
    rows = spark.createDataFrame(EVENTS, "user_id long, kind string, ts timestamp")
    arrange_by_time(rows, "ts", path, 4)
    folder = path.removeprefix("file:")
    names = sorted(n for n in os.listdir(folder) if n.startswith("part-"))
    names.sort(key=lambda n: os.stat(f"{folder}/{n}").st_mtime)
    spans = [spark.read.parquet(f"{path}/{n}").agg(F.min("ts"), F.max("ts")).first() for n in names]
    assert len(names) > 1
    assert all(before[1] <= after[0] for before, after in zip(spans, spans[1:]))


def test_documents_on_a_stream(spark):
    from shapes import driver_shape, yaml_payload

    path = scratch_path(spark, "docs")
    spark.createDataFrame([(yaml_payload("SOMEDRIVER"),), ("a: [",)], "payload string").write.parquet(path)
    read = read_yaml_record(
        stream_parquet(spark, path), "payload", driver_shape("someDriver"), on_error="quarantine"
    )
    output, _ = run_stream(
        read.select(F.col("doc.someDriver.engine.maxThreads").alias("n"), "doc_error"), "docs", timeout=60
    )
    rows = output.orderBy("n").collect()
    assert [r["n"] for r in rows] == [None, 6]
    assert rows[0]["doc_error"] and rows[1]["doc_error"] is None


def laid_out(spark, rows, batches, name="ts", **options):
    df = spark.createDataFrame(rows, f"user_id long, kind string, {name} timestamp")
    return lay_out(df, name, scratch_path(spark, "laid out"), batches, **options)


def test_layout_by_time(spark):
    rows = [(i, "k", START + timedelta(minutes=i % 700)) for i in range(3000)] + [(None, "n", None)] * 3
    rows += [(1, "hot", START + timedelta(minutes=350))] * 1000
    layout = laid_out(spark, rows, 6)
    assert layout.rows == len(rows) and 1 < layout.batches <= 6
    output, run = run_stream(
        stream_manifest(spark, layout).withColumn("n", F.lit(1)), "laid", batches=layout.batches, timeout=120)
    assert sorted(map(str, output.drop("n").collect())) == sorted(map(str, spark.createDataFrame(
        rows, "user_id long, kind string, ts timestamp").collect()))
    assert run.batches == layout.batches
    only = stream_manifest(spark, layout, columns=["ts"])
    assert only.columns == ["ts"]
    output, _ = run_stream(only, "column", batches=layout.batches, timeout=120)
    assert output.count() == len(rows)


def test_batches_of_a_layout_follow_each_other(spark):
    rows = [(i, "k", START + timedelta(minutes=i * 7 % 1000)) for i in range(1000)]
    cuts = [micros(5), micros(10), micros(99)]
    layout = laid_out(spark, rows, 1, cuts=cuts, closing=3600)
    assert layout.batches == 4  # none begins at the last cut; the closing row is one
    seen = stream_manifest(spark, layout).groupBy(F.lit(1)).agg(F.max("ts").alias("t"))
    query = (seen.writeStream.format("memory").queryName("laid_times").outputMode("complete")
             .option("checkpointLocation", scratch_path(spark, "times")).trigger(processingTime="0 seconds").start())
    run = finish(query, 120, batches=layout.batches)
    assert run.ends == [{"batch": 4}]
    last = spark.table("laid_times").first()["t"]
    assert last == max(row[2] for row in rows) + timedelta(hours=1)


def test_a_layout_of_no_rows(spark):
    layout = laid_out(spark, [], 3, closing=60)
    assert layout[1:] == (0, 0)
    stream = stream_manifest(spark, layout).withWatermark("ts", "0 seconds")
    output, run = run_stream(last_before(stream, "user_id", "ts", "kind", ("view", "click"), 60), "none",
                             batches=layout.batches, timeout=120, state_partitions=1)
    assert output.collect() == [] and run.last_state == 0


def test_restart_on_a_manifest(spark):
    rows = [(1, "k", START + timedelta(minutes=i)) for i in range(400)]
    layout = laid_out(spark, rows, 4)
    output, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "state")
    for batches in (2, 2, layout.batches, layout.batches):
        stream = stream_manifest(spark, layout, position=f"{checkpoint}-position")
        query = start_stream(stream, output, checkpoint, available_now=False)
        finish(query, 120, batches=batches)
        done = spark.read.parquet(output).count()
        assert done == spark.read.parquet(output).distinct().count() >= 100 * batches - 20
    assert done == len(rows)


def plain_chains(rows, steps, within):
    """For each last step, by going back from it."""
    found = []
    for user, kind, at in rows:
        if user is None or at is None or kind != steps[-1]:
            continue
        chain, now = [at], at
        for step in reversed(steps[:-1]):
            earlier = [t for u, k, t in rows if u == user and k == step and t is not None and now is not None and t < now]
            best = max(earlier, default=None)
            now = best if best is not None and (now - best).total_seconds() <= within else None
            chain.append(now)
        found.append((user, *[None if t is None else micros((t - START).total_seconds() / 3600) for t in reversed(chain)]))
    return sorted(found, key=str)


@pytest.mark.parametrize("batches", [1, 4])
def test_chains_of_single_events(spark, batches):
    import random

    rng = random.Random(batches)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["view", "click", "buy", "other"]),
             START + timedelta(minutes=rng.randrange(3000))) for _ in range(400)]
    rows += [(7, "view", START), (7, "click", START), (7, "buy", START), (8, "buy", None), (9, "buy", START)]
    steps, within = ("view", "click", "buy"), 5 * 3600
    layout = laid_out(spark, rows, batches, closing=2 * within)
    stream = stream_manifest(spark, layout).withWatermark("ts", "0 seconds")
    output, run = run_stream(last_before(stream, "user_id", "ts", "kind", steps, within), "chains",
                             batches=layout.batches, timeout=300, state_partitions=2)
    assert output.columns == ["user_id", "view_time", "click_time", "buy_time"]
    assert sorted(map(tuple, output.collect()), key=str) == plain_chains(rows, steps, within)
    # All state has gone once the watermark has passed it.
    assert run.dropped == 0 and run.peak_state > 0 and run.last_state == 0


def test_chains_wait_for_late_rows(spark):
    first = hours((1, "view", 0), (1, "buy", 3), (2, "click", 30))
    late = hours((1, "click", 2), (1, "view", 1), (2, "buy", 60))
    end = hours((5, "other", 200))
    path = write_batches(spark, first, late, end)
    stream = stream_parquet(spark, path, files_per_trigger=1).withWatermark("ts", "40 hours")
    output, run = run_stream(last_before(stream, "user_id", "ts", "kind", ("view", "click", "buy"), 36_000),
                             "late", timeout=300, state_partitions=1)
    assert sorted(map(tuple, output.collect()), key=str) == [
        (1, micros(1), micros(2), micros(3)), (2, None, None, micros(60))]


def test_chains_of_a_hot_user(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    n = 60_000
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("user_id"),
        F.element_at(F.array(*map(F.lit, CHAIN)), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        F.timestamp_micros((F.col("id") * 7_919_333) % (n * 1_000_003) + 1_704_067_200_000_000).alias("ts"))
    layout = lay_out(df, "ts", scratch_path(spark, "hot"), 3, closing=2 * WITHIN)
    stream = stream_manifest(spark, layout).withWatermark("ts", "0 seconds")
    output, run = run_stream(last_before(stream, "user_id", "ts", "kind", CHAIN, WITHIN), "hot",
                             batches=layout.batches, timeout=300, state_partitions=2)
    ids = np.arange(n)
    at = (ids * 7_919_333) % (n * 1_000_003) + 1_704_067_200_000_000
    view, click, buy = (np.sort(at[ids % 3 == kind]) for kind in range(3))
    before = np.searchsorted(click, buy, "left") - 1
    got = np.array(output.orderBy("purchase_time").select("purchase_time", "click_time").fillna(-1).collect())
    assert np.array_equal(got[:, 0], buy)
    assert np.array_equal(got[:, 1], np.where(before >= 0, click[np.maximum(before, 0)], -1))
    assert run.peak_state < 20 and run.last_state == 0


def test_chains_give_equal_rows_for_any_batches(spark):
    runs = [chain_events_run(spark, "/root/testdata/sf0.001", batches) for batches in (1, 3, 12)]
    rows = [sorted(map(tuple, output.collect()), key=str) for output, _ in runs]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) > 100
    users = len({row[0] for row in rows[0]})
    assert [run.batches >= n for (_, run), n in zip(runs, (1, 3, 12))] == [True] * 3
    assert all(run.peak_state <= 3 * users and run.last_state == 0 for _, run in runs)


def test_state_as_a_table(spark):
    later = [hours((9, "view", at), (9, "click", at), (9, "buy", at)) for at in (90, 120)]
    path = write_batches(spark, EVENTS, *later)
    output, done = run_stream(
        chain(stream_parquet(spark, path, files_per_trigger=1)), "t", timeout=120, state_partitions=2)
    steps = stateful_steps(spark, done.checkpoint).select("operatorName").distinct().collect()
    assert {row[0] for row in steps} == {"dedupe", "symmetricHashJoin"}
    kinds = {row["operatorId"]: row["operatorName"] for row in stateful_steps(spark, done.checkpoint).collect()}
    one = state_rows(spark, done.checkpoint, max(kinds), batch=0)
    assert one.columns == ["step", "batch", "partition", "key", "value"]

    def held(batch):
        parts = [(step, side) for step, kind in kinds.items()
                 for side in (("left", "right") if kind == "symmetricHashJoin" else (None,))]
        return sum(state_rows(spark, done.checkpoint, step, batch, side=side).count() for step, side in parts)

    assert held(0) > held(done.batches - 1) == held(None)


def test_state_partitions_follow_the_rows(spark):
    assert state_partitions(spark, 0) == state_partitions(spark, STATE_ROWS) == 1
    assert state_partitions(spark, 3 * STATE_ROWS) == 3
    assert state_partitions(spark, 10**12) == 8


def test_state_partitions_cost_no_more_than_the_rows_need(spark):
    cores = spark.sparkContext.defaultParallelism
    with session_conf(spark, {"spark.sql.shuffle.partitions": "200"}):
        assert state_partitions(spark, STATE_ROWS * 150) == cores
        assert state_partitions(spark, FULL_STATE_ROWS * cores + 1) == 2 * cores
        assert state_partitions(spark, 10**12) == 200


def test_chains_of_many_keys_share_their_state(spark):
    rows = [(f"u{user}", kind, START + timedelta(minutes=user % 50 + 90 * at))
            for user in range(600) for at, kind in enumerate(("view", "click", "buy", "click", "buy"))]
    df = spark.createDataFrame(rows, "user_id string, kind string, ts timestamp")
    layout = lay_out(df, "ts", scratch_path(spark, "many"), 3, closing=20_000)
    stream = stream_manifest(spark, layout).withWatermark("ts", "0 seconds")
    steps = ("view", "click", "buy")
    output, run = run_stream(
        last_before(stream, "user_id", "ts", "kind", steps, 6000, group_count(layout.rows)), "many",
        batches=layout.batches, timeout=300, state_partitions=2)
    assert sorted(map(tuple, output.collect()), key=str) == plain_chains(rows, steps, 6000)
    assert group_count(layout.rows) == 1 and 0 < run.peak_state < 20 and run.last_state == 0
