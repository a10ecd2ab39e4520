"""Session set-up for local runs. On a cluster the session comes from the platform."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "shiori", cpus: int | None = None, memory: str = "12g") -> SparkSession:
    cores = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
