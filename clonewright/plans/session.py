"""Session defaults for tests, bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, name: str = "clonewright", **conf: str) -> SparkSession:
    """A local session; on a cluster the caller's own session is used as it is."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores if isinstance(cores, int) else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("CLONEWRIGHT_DRIVER_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
