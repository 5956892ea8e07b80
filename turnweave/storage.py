"""Tables and files in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = "/tmp/checkpoints/turnweave"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, one of our own if the master is local, as in tests, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{_OWN}"
    return base.rstrip("/")


def local_path(path: str) -> str:
    """A file: URI as a plain path."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tw-{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark, path)
    return path


def _removed(spark: SparkSession, path: str) -> None:
    if path.startswith(("file:", "/")):
        shutil.rmtree(local_path(path), ignore_errors=True)
    elif spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():  # a store: through Hadoop while there is a session
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, is not computed again."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col(f"`{name.replace('`', '``')}`")
