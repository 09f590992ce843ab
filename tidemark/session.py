"""Session settings for tests, the bench and local use.

On a cluster the caller brings its own session; nothing in the library
sets a value there.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", app: str = "tidemark", **more: str) -> SparkSession:
    """A local session with UTC time, AQE and one shuffle partition a core."""
    conf = {
        "spark.sql.shuffle.partitions": "8" if cpus == "*" else str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | more
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(app).config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
