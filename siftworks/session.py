"""Session defaults for local runs and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "siftworks", master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    """A UTC session with adaptive execution; on a cluster the session of the caller is used instead."""
    return (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
