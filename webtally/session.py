"""SparkSession settings the reports are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # Adaptive execution picks a broadcast only for a side whose measured size is below this bound.
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
}


def build_session(app_name: str = "webtally", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the library's defaults. On a cluster leave ``master`` unset and give
    ``spark.sql.shuffle.partitions`` two to three times the number of cores; AQE merges small ones."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
