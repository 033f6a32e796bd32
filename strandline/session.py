"""A session for scripts; on a cluster, spark-submit's settings stand."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "strandline", cores: int | None = None) -> SparkSession:
    cores = cores or os.cpu_count() or 1
    return (
        SparkSession.builder.appName(name)
        .master(os.environ.get("SPARK_MASTER", f"local[{cores}]"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
