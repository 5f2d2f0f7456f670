"""Times design choices against their alternatives; prints one JSON line per pair.

Uses the tables of BENCH_SF_DIR, on local[BENCH_CPUS]; the best of three runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pandas as pd  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidemark.operators.settings import merge_layers, merge_settings, restrict_keys  # noqa: E402
from tidemark.plans import documents, settings  # noqa: E402
from tidemark.plans.tables import load  # noqa: E402
from tidemark.session import scratch_path, session_conf  # noqa: E402
from tidemark.sources.files import write_parquet  # noqa: E402


def best(work, runs: int = 3) -> float:
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        work()
        times.append(time.perf_counter() - start)
    return round(min(times), 3)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timestamp_filter(spark, sf_dir):
    """A narrow range of a timestamp column, with and without row-group statistics."""
    lines = load(spark, sf_dir, "lineitem").withColumn("at", F.col("l_shipdate").cast("timestamp"))
    with_stats, without = scratch_path(spark, "micros"), scratch_path(spark, "int96")
    groups = {"parquet.block.size": str(1024 * 1024)}
    with session_conf(spark, groups):
        write_parquet(lines, with_stats, sort_within=["at"])
    with session_conf(spark, {**groups, "spark.sql.parquet.outputTimestampType": "INT96"}):
        lines.sortWithinPartitions("at").write.parquet(without)

    def read(path):
        rows = spark.read.parquet(path)
        return rows.where(
            (F.col("at") >= F.lit("1996-01-01").cast("timestamp"))
            & (F.col("at") < F.lit("1996-02-01").cast("timestamp"))
        )

    return {"micros": best(lambda: drain(read(with_stats))), "int96": best(lambda: drain(read(without)))}


def yaml_record(spark, sf_dir):
    """Typed YAML reading against a UDF that does all of it in Python."""
    import yaml

    events = documents._yaml_events(spark, sf_dir, F.lit(True), F.lit(""))
    schema = "id bigint, kind string, amount double, isPaid boolean, userId bigint, marks array<bigint>"

    def python_only(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            event = {k.lower(): v for k, v in yaml.load(text, Loader=yaml.CSafeLoader).items()}["event"]
            event = {k.lower(): v for k, v in event.items()}
            owner = {k.lower(): v for k, v in event["owner"].items()}
            rows.append((event["id"], event["kind"], event["amount"], event["ispaid"],
                         owner["userid"], event["marks"]))
        return pd.DataFrame(rows, columns=["id", "kind", "amount", "isPaid", "userId", "marks"])

    udf = F.pandas_udf(python_only, schema)
    return {
        "library": best(lambda: drain(documents.yaml_struct_ci(spark, sf_dir))),
        "python_only": best(lambda: drain(events.select(udf("payload").alias("e")))),
    }


def layered_merge(spark, sf_dir):
    """The restriction inside the merge's aggregation against a join before it."""

    def by_join():
        injected, submitted, default = settings._layers(spark, sf_dir)
        kept = restrict_keys(submitted, injected, default)
        return merge_layers([
            layer.withColumn("priority", F.lit(p))
            for p, layer in ((1, injected), (2, kept), (3, default))
        ])

    return {
        "one_aggregation": best(lambda: drain(merge_settings(*settings._layers(spark, sf_dir)))),
        "join_then_merge": best(lambda: drain(by_join())),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    try:
        for compare in (timestamp_filter, yaml_record, layered_merge):
            print(json.dumps({"comparison": compare.__name__, **compare(spark, sf_dir)}), flush=True)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
