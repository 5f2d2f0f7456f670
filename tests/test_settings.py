"""Settings as data."""

import os
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions.render import render, stable_id, without_newlines
from tidemark.functions.runtime import runtime_of
from tidemark.operators.documents import read_json, read_yaml
from tidemark.operators.joins import join_lookup, lookup_bytes
from tidemark.operators.settings import (
    filter_names,
    merge_layers,
    merge_settings,
    render_from_table,
    restrict_keys,
)
from tidemark.operators.settings_record import FIELDS, read_settings
from tidemark.plans.cache_demo import cache_demo, main, settings_from_files
from tidemark.session import scratch_path, session_conf
from tidemark.sources.settings_table import session_settings

SCHEMA = "scope string, key string, value string"

SETTINGS_YAML = """
telemetry: {isRelay: true, audience: "listeners", url: ""}
secret:
  devcontainer: {storageLocation: "file://{GIT_ROOT}/private"}
spark:
  driverCore: 3
  driverMemory: "5g"
  executorCore: 2
  executorMemory: "7g"
  offHeapEnabled: true
  offHeapMemory: "1g"
  shufflePartitions: 9
  seedRootPath: "file://{GIT_ROOT}/seed/{RANDOM_STRING}"
  metastoreRootPath: "file://{GIT_ROOT}"
  warehouseRootPath: "file://{GIT_ROOT}/tables"
  checkpointsRootPath: "file://{GIT_ROOT}/marks"
  local: true
  debug: false
  ui: false
  state:
    rocksDb: {compactOnCommit: false}
    minBatchesToRetain: 4
    storeProviderClass: "org.example.Store"
"""


def layer(spark, *rows):
    return spark.createDataFrame([("s", *row) for row in rows], SCHEMA)


def as_dict(df):
    rows = [(r["key"], r["value"]) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_merge_precedence(spark):
    injected = layer(spark, ("all", "i"), ("injected", "i"))
    submitted = layer(spark, ("all", "s"), ("low", "s"), ("stray", "s"))
    default = layer(spark, ("all", "d"), ("low", "d"), ("default", "d"))
    merged = as_dict(merge_settings(injected, submitted, default))
    assert merged == {"all": "i", "injected": "i", "low": "s", "default": "d"}
    kept = restrict_keys(submitted, injected, default)
    assert as_dict(kept) == {"all": "s", "low": "s"}
    by_join = merge_layers([
        frame.withColumn("priority", F.lit(p))
        for p, frame in ((1, injected), (2, kept), (3, default))
    ])
    assert as_dict(by_join) == merged


def test_merge_keeps_scopes_apart_and_null_values(spark):
    injected = spark.createDataFrame([("a", "k", None)], SCHEMA)
    default = spark.createDataFrame([("a", "k", "d"), ("b", "k", "e")], SCHEMA)
    submitted = spark.createDataFrame([("b", "k", "s"), ("c", "k", "s")], SCHEMA)
    rows = merge_settings(injected, submitted, default).collect()
    assert {tuple(r) for r in rows} == {("a", "k", None), ("b", "k", "s")}


def test_merge_is_one_shuffle_of_partly_merged_rows(spark, capsys):
    frames = [layer(spark, ("k", "v"))] * 3
    merge_settings(*frames).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("Exchange (") == 1
    assert "partial_min_by" in plan and "Join" not in plan


def test_merge_of_a_hot_key(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("scope"),
        F.lit("k").alias("key"), F.col("id").cast("string").alias("value"),
    )
    merged = merge_settings(rows.where("scope = 'hot'"), rows, rows)
    assert merged.count() == 20_001
    assert merged.where("scope = 'hot'").first()["value"] == "0"


def test_placeholders(spark):
    rows = [
        (1, "local: true\np: {GIT_ROOT}\nr: {RANDOM_STRING} {RANDOM_STRING}\n"),
        (2, "local:   true # {GIT_ROOT}"), (3, "local: false\np: {GIT_ROOT}"), (4, "p: {GIT_ROOT}"),
        (5, "a: 1\nlocal:\n  true\np: {GIT_ROOT}"), (6, "local:true {GIT_ROOT}"), (7, None),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    root = without_newlines(F.lit("/r$1\\x\r\n"))
    filled = df.select("id", render(F.col("text"), {
        "GIT_ROOT": root, "RANDOM_STRING": stable_id(None, F.col("id"), "run"),
    }).alias("t"))
    out = {r["id"]: r["t"] for r in filled.collect()}
    assert out[1].startswith("local: true\np: /r$1\\x\nr: null")
    first, second = out[1].split("r: ")[1].split()
    assert first == second and len(first) == len("null") + 36
    assert out[2] == "local:   true # /r$1\\x"
    assert out[3] == rows[2][1] and out[4] == rows[3][1] and out[6] == rows[5][1]
    assert out[5].endswith("p: /r$1\\x") and out[7] is None
    assert filled.collect() == filled.collect()


def test_placeholders_from_a_table(spark):
    docs = spark.createDataFrame(
        [(1, "a", "local: true {X} {Y}"), (2, "b", "local: true {X} {Y}"), (3, "c", "local: true {X}")],
        "id int, scope string, text string",
    )
    variables = spark.createDataFrame(
        [("a", "X", "1"), ("a", "Y", "2"), ("b", "X", "3"), ("a", "Z", "9")],
        "scope string, name string, value string",
    )
    out = render_from_table(docs, "text", variables, ["X", "Y"])
    assert [r["text"] for r in out.orderBy("id").collect()] == [
        "local: true 1 2", "local: true 3 null", "local: true null",
    ]
    assert out.columns == ["scope", "id", "text"]


def test_placeholders_of_several_names_take_one_join(spark):
    docs = spark.range(2000).select(
        (F.col("id") % 50).cast("string").alias("scope"), "id",
        F.lit("local: true {X} {Y} {Z}").alias("text"))
    scopes = docs.select("scope").distinct()
    variables = scopes.select("scope", F.inline(F.array(*[
        F.struct(F.lit(name).alias("name"), F.concat(F.lit(name), "scope").alias("value"))
        for name in ("X", "Y", "Z")])))
    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1",
                              "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                              "spark.sql.adaptive.enabled": "false"}):
        large = render_from_table(docs, "text", variables, ["X", "Y", "Z"], limit_bytes=0)
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1
        documents = plan[:plan.index("HashAggregate")]
        assert documents.count("Exchange hashpartitioning") == 1
        assert large.where("id = 7").first()["text"] == "local: true X7 Y7 Z7"
    small = render_from_table(docs, "text", variables, ["X", "Y", "Z"])
    assert sorted(small.collect()) == sorted(large.collect())
    with pytest.raises(ValueError):
        render_from_table(docs, "text", variables.union(variables.limit(1)), ["X", "Y", "Z"])
    nothing = spark.createDataFrame([(None, "X", "a"), (None, "X", "b")], variables.schema)
    assert render_from_table(docs, "text", nothing, ["X"]).first()["text"] == "local: true null {Y} {Z}"


def test_lookups_of_any_column_type_are_measured(spark):
    texts = F.array([F.lit("x" * 1000)] * 10)
    table = spark.range(5).select(
        F.col("id").alias("k"), texts.alias("a"), F.create_map(F.lit("m"), texts).alias("m"),
        F.struct(texts.alias("t")).alias("s"), F.to_variant_object(F.struct(texts.alias("t"))).alias("v"))
    assert lookup_bytes(table, "k") > 5 * 4 * 10_000
    nulls = spark.createDataFrame([(None, "a"), (None, "b"), (1, "c")], "k long, v string")
    assert lookup_bytes(nulls, "k") == 32 + 1
    joined = join_lookup(spark.createDataFrame([(None,), (1,)], "k long"), nulls, "k")
    assert sorted(r["v"] or "" for r in joined.collect()) == ["", "c"]


def test_lookup_join_is_the_same_on_both_sides_of_the_limit(spark, capsys):
    docs = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    table = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert lookup_bytes(table, "k") == 5 * (32 + 1)
    assert lookup_bytes(table.where("k < 0"), "k") == 0
    with pytest.raises(ValueError):
        join_lookup(docs, table.union(table), "k")
    small = join_lookup(docs, table, "k")
    large = join_lookup(docs, table, "k", limit_bytes=0)
    assert small.exceptAll(large).count() == large.exceptAll(small).count() == 0
    assert small.count() == 1000
    small.explain()
    assert "BroadcastHashJoin" in capsys.readouterr().out


def test_settings_record_of_a_yaml_document(spark):
    df = spark.createDataFrame([(SETTINGS_YAML,)], "text string")
    df = df.withColumn("text", render(F.col("text"), {"GIT_ROOT": "/repo", "RANDOM_STRING": "r"}))
    record = read_settings(read_yaml(df, "text"), "doc", driver="job").first()["settings"]
    assert record["local"] is True and record["driverCore"] == 3
    assert record["warehouseRootPath"] == "file:///repo/tables"
    assert record["seedRootPath"] == "file:///repo/seed/r"
    assert record["metastoreRootPath"] == "file:///repo"
    assert record["storeProviderClass"] == "org.example.Store"
    assert record["telemetry"].asDict() == {"url": "", "audience": "listeners", "isRelay": True}
    assert record["driver"] is None and record["tokenCredential"] is None
    assert record["secret"] is not None
    names = set(record.asDict())
    assert names == {
        *FIELDS["spark"], *FIELDS["spark.state"], "secret", "tokenCredential", "driver", "telemetry",
    }


@pytest.mark.parametrize("text, problem", [
    ("{}", "missing block spark"),
    ('{"spark": null}', "missing block spark"),
    ('{"spark": {"local": true}}', "missing block spark.state"),
    ('{"spark": {"state": {}, "driverCore": "8"}}', "spark.driverCore is not int"),
    ('{"spark": {"state": {}, "local": "true"}}', "spark.local is not boolean"),
    ('{"spark": {"state": {}, "driverMemory": 8}}', "spark.driverMemory is not string"),
])
def test_settings_record_refuses(spark, text, problem):
    read = read_json(spark.createDataFrame([(text,)], "text string"), "text")
    with pytest.raises(PySparkException, match=problem):
        read_settings(read, "doc").collect()
    read_settings(read, "doc", strict=False).collect()


def test_settings_record_gaps(spark):
    texts = ['{"spark": {"state": {}}}',
             '{"spark": {"state": {}, "metastoreRootPath": null}, "telemetry": {"url": null}}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    first, second = [
        r["settings"] for r in read_settings(read_json(df, "text"), "doc").orderBy("id").collect()
    ]
    assert first["local"] is False and first["driverCore"] is None and first["driverMemory"] is None
    assert first["metastoreRootPath"] == "" and second["metastoreRootPath"] is None
    assert first["telemetry"].asDict() == {"url": "", "audience": "", "isRelay": False}
    assert second["telemetry"].asDict() == {"url": None, "audience": "", "isRelay": False}


def test_runtime(spark):
    rows = [(1, True, "synapse"), (2, False, "synapse"), (3, False, "trident"),
            (4, False, "xsynapse"), (5, False, None), (6, None, "trident")]
    df = spark.createDataFrame(rows, "id int, local boolean, kind string")
    tolerant = df.select("id", runtime_of(F.col("local"), F.col("kind"), "null").alias("r"))
    assert [r["r"] for r in tolerant.orderBy("id").collect()] == [
        "devcontainer", "synapse", "fabric", None, None, "fabric",
    ]
    with pytest.raises(PySparkException, match="Unknown Spark runtime"):
        df.select(runtime_of(F.col("local"), F.col("kind"))).collect()
    with pytest.raises(ValueError):
        runtime_of(F.col("local"), F.col("kind"), "skip")


def test_name_filter(spark):
    df = spark.createDataFrame([("app.core.a",), ("app.core",), ("org.other",), (None,)], "name string")

    def names(**rule):
        return sorted(r["name"] for r in filter_names(df, "name", **rule).collect())

    assert names(regex="(app.core(.*))$") == ["app.core", "app.core.a"]
    assert names(match=["app.core"]) == ["app.core"]
    assert names(match=["org.other"], regex=r"\.a$") == ["app.core.a", "org.other"]
    with pytest.raises(ValueError):
        filter_names(df, "name")


def test_session_settings(spark):
    rows = [(r["key"], r["value"]) for r in session_settings(spark).collect()]
    assert rows == sorted(spark.sparkContext.getConf().getAll())
    assert session_settings(spark).columns == ["key", "value"]
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        assert dict(rows)["spark.sql.shuffle.partitions"] == "4"
        runtime = as_dict(session_settings(spark, runtime=True))
        assert runtime["spark.sql.shuffle.partitions"] == "5"
        assert set(dict(rows)) <= set(runtime)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_settings_files_end_to_end(spark):
    path = scratch_path(spark, "settings-files").removeprefix("file:")
    os.makedirs(path)
    for name, local in (("a", "true"), ("b", "false")):
        with open(f"{path}/{name}.yaml", "w") as handle:
            handle.write(SETTINGS_YAML.replace("local: true", f"local: {local}"))
    read = settings_from_files(
        spark, path, {"GIT_ROOT": "/repo", "RANDOM_STRING": "r"}, driver="secret"
    )
    rows = {os.path.basename(r["path"]): r["settings"] for r in read.collect()}
    assert rows["a.yaml"]["metastoreRootPath"] == "file:///repo"
    assert rows["b.yaml"]["metastoreRootPath"] == "file://{GIT_ROOT}"
    assert rows["a.yaml"]["driver"] is not None


def test_cache_demo(spark):
    rows = cache_demo(spark).collect()
    assert [(r["round"], r["rows"], r["status"]) for r in rows] == [
        (n, 5000, 200) for n in range(1, 6)
    ]
    assert main([]) == 1
    assert main(["settings.yaml", "no value"]) == 1


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


SMALL_SCALE_SKEW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


def test_a_hot_key_is_split_in_the_key_restriction(spark):
    rows = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("scope"),
        F.lit("k").alias("key"), F.md5(F.col("id").cast("string")).alias("value"),
    )
    keys = rows.where("scope = 'hot' OR scope < '2'")
    with session_conf(spark, SMALL_SCALE_SKEW):
        kept = restrict_keys(rows, keys, keys.where("scope = 'hot'"))
        assert "skew=true" in final_plan(kept)
        assert kept.count() == keys.count()


def test_the_key_restriction_shuffles_each_side_once(spark):
    rows = layer(spark, ("a", "1"), ("b", "2"))
    with session_conf(spark, {**SMALL_SCALE_SKEW, "spark.sql.adaptive.enabled": "false"}):
        plan = restrict_keys(rows, rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_equal_rows_of_a_hot_key_are_spread_in_a_large_lookup(spark):
    rows = spark.range(0, 30_000, 1, 16).select(
        F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id") % 1000).alias("k"),
        F.lit("the same text in every row").alias("text"))
    table = spark.range(-1, 900).select(F.col("id").alias("k"), F.col("id").alias("v"))
    with session_conf(spark, {**SMALL_SCALE_SKEW, "spark.sql.shuffle.partitions": "64",
                              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500",
                              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "500"}):
        joined = join_lookup(rows, table, "k", limit_bytes=0)
        assert "skew=true" in final_plan(joined)
        places = joined.withColumn("p", F.spark_partition_id())
        assert places.where("k = -1").select("p").distinct().count() > 1
        assert joined.count() == 30_000
        assert joined.where("v IS NOT NULL AND v <> k").count() == 0
        assert joined.where("v IS NULL").count() == rows.where("k >= 900").count()


def test_placeholders_as_if_replaced_in_turn(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(20)] + ["a", "b", "ab", "NAME_X"]
    pieces = [*("{" + name + "}" for name in names), "{", "}", "{a", "b}", "$1", "\\", " ", "text", "{unknown}", "{}", "local: true\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(12))) + rng.choice(["", "local: true"])
             for _ in range(1500)]
    plain = ["v", "", "$2", "\\n", "null", "ü" * 9]
    values = [{name: rng.choice([*plain, None]) for name in names} for _ in texts]
    for value in values[::3]:  # some hold braces, placeholders among them
        value[rng.choice(names)] = rng.choice(["{b}", "{", "}", "x{n3}y", "{a{b}}"])

    def in_turn(text, value):
        if not re.search(r"local:\s+true", text):
            return text
        for name in names:
            text = text.replace("{" + name + "}", "null" if value[name] is None else value[name])
        return text

    schema = "id int, text string, " + ", ".join(f"`{name}` string" for name in names)
    df = spark.createDataFrame(
        [(i, text, *(value[name] for name in names)) for i, (text, value) in enumerate(zip(texts, values))], schema)
    got = df.select("id", render(F.col("text"), {name: F.col(name) for name in names}).alias("text"))
    assert {r["id"]: r["text"] for r in got.collect()} == {
        i: in_turn(text, value) for i, (text, value) in enumerate(zip(texts, values))}
    fixed = df.select(render(F.col("text"), {"a": "{b}", "b": "x", "c{": "y"}).alias("text")).collect()
    assert all("{a}" not in r["text"] for r in fixed if re.search(r"local:\s+true", r["text"]))
    assert spark.range(1).select(render(F.lit("local: true {a}"), {}).alias("t")).first()["t"] == "local: true {a}"
