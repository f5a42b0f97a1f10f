"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Time stamps are compared in UTC; everything else is left to the cluster.
REQUIRED = {"spark.sql.session.timeZone": "UTC"}


def local_session(cores: str = "8", name: str = "lanternlake", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = REQUIRED | {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
