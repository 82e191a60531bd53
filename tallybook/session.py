"""Session for tests, the bench and a first look on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str, cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session; on a cluster the session is given, not built here.

    Adaptive execution is on by default in Spark and is what splits a hot join
    key at run time; nothing here turns it off or tunes it for small data.
    """
    settings = {
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
