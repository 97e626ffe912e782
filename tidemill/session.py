"""Session settings that the plans assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | None = None, app: str = "tidemill", **more: str) -> SparkSession:
    """A session on this machine, for tests and benchmarks. On a cluster use the session given."""
    n = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{n}]").appName(app).config("spark.sql.shuffle.partitions", str(n)).config("spark.driver.memory", "6g")
    for k, v in (SETTINGS | more).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
