"""Which runtime a job runs on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cluster type → runtime; anything local is a devcontainer.
LOCAL_RUNTIME = "devcontainer"
RUNTIME_OF_CLUSTER = {"synapse": "synapse", "trident": "fabric"}
UNKNOWN_RUNTIME = "Unknown Spark runtime environment"


def runtime_of(local: Column, cluster_type: Column, on_unknown: str = "fail") -> Column:
    """Classify by the local flag, then by the exact cluster type.

    An unknown type fails the job, or gives NULL with ``on_unknown="null"``.
    """
    if on_unknown not in ("fail", "null"):
        raise ValueError("on_unknown is 'fail' or 'null'")
    result = F.when(local, F.lit(LOCAL_RUNTIME))
    for cluster, runtime in RUNTIME_OF_CLUSTER.items():
        result = result.when(cluster_type == cluster, F.lit(runtime))
    if on_unknown == "null":
        return result.otherwise(F.lit(None).cast("string"))
    return result.otherwise(F.raise_error(F.lit(UNKNOWN_RUNTIME)).cast("string"))
