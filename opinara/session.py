"""A Spark session with the settings the jobs expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "opinara", cores: str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster, pass your own session instead."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def let_workers_import(spark: SparkSession) -> None:
    """Have Python workers find this package where the driver found it.

    For machines that see the same folder (local mode, a shared installation);
    elsewhere ship the package with ``--py-files``, which comes first.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
