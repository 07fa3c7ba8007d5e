"""Session factory: the settings every job of this package relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Needed for right results anywhere; sizes are left to the cluster's own defaults.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints go once nothing refers to them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str = "8", **more: str) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    settings = {
        **SETTINGS,
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
        **more,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("tidemark")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
