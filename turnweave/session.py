"""Session construction used by the tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "turnweave", cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session with the settings the plans assume (UTC, AQE, Arrow); extra options win."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    } | extra
    return SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=conf).getOrCreate()
