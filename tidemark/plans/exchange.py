"""Parameters to the executors and reports back, on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.exchange import observed, with_parameter_from, with_parameters
from tidemark.plans.tables import load
from tidemark.session import fresh_name

# The parameter the driver hands out, and the factor of the report.
PARAMETER = 10
REPORT_FACTOR = 10


def broadcast_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event scaled by a value that reaches the executors with the plan."""
    parameter = spark.createDataFrame([(PARAMETER,)], "v int")
    events = load(spark, sf_dir, "events").select("event_id")
    return with_parameter_from(events, parameter, "v", "param").select(
        "event_id", (F.col("event_id") * F.col("param")).alias("scaled")
    )


def observed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and count reported to the driver while the rows are being written."""
    events = with_parameters(load(spark, sf_dir, "events"), {"param": PARAMETER})
    watched, observation = observed(
        events, fresh_name("report"),
        {
            "total": F.sum(F.col("event_id") * F.col("param")),
            "reported": F.max(F.col("param") * REPORT_FACTOR),
            "n": F.count(F.lit(1)),
        },
    )
    watched.write.format("noop").mode("overwrite").save()
    report = observation.get
    return spark.createDataFrame(
        [(report["total"], report["reported"], report["n"])],
        "total bigint, reported int, n bigint",
    )


QUERIES = {"broadcast_param": broadcast_param, "observed_report": observed_report}

ORACLES = {
    "broadcast_param": "SELECT event_id, event_id * 10 AS scaled FROM events",
    "observed_report": """
        SELECT CAST(sum(event_id * 10) AS BIGINT) AS total,
               CAST(10 * 10 AS INTEGER) AS reported, count(*) AS n
        FROM events
    """,
}
