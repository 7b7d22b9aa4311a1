"""Session with the settings the marts are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Runtime sizes are known exactly, so a larger limit than the planner's 10 MB is safe.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "flockmetrics", **overrides: str) -> SparkSession:
    """Settings suit a cluster; pass ``master`` and Spark options (dots as ``__``) to change them."""
    builder = SparkSession.builder.appName(app)
    master = overrides.pop("master", None)
    if master:
        builder = builder.master(master)
    options = SETTINGS | {key.replace("__", "."): value for key, value in overrides.items()}
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
