"""The session that tests and the bench use; on a cluster the caller brings its own."""

import os

from pyspark.sql import SparkSession


def session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session: UTC, AQE on. Shared settings of a cluster are never overridden, as this is not called there."""
    os.environ.setdefault("TZ", "UTC")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
