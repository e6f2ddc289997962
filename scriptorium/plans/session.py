"""Sessions: the settings the engine's plans assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.unionOutputPartitioning": "false",  # adaptive execution may merge the partitions of a union's sides differently
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int | None = None, partitions: int = 8, memory: str = "6g") -> SparkSession:
    """One-machine session, as tests and the benchmark use it; a cluster brings its own master and partition count."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cores}]").appName("scriptorium")
    for k, v in SETTINGS.items():
        builder = builder.config(k, v)
    spark = builder.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
