"""Sessions with the settings that the engine is written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: ANSI arithmetic, UTC, adaptive plans with skew joins, and Arrow between JVM and Python.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tessera", master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session for tests, benches and notebooks. On a cluster, spark-submit's own settings win over ``master``."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    if master:
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(shuffle_partitions or os.cpu_count() or 8)).config("spark.ui.enabled", "false")
    return builder.getOrCreate()
