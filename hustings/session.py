"""Session settings shared by tests, the benchmark and scripts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = 8, shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session; on a cluster, callers pass their own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hustings")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
