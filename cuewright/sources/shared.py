"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below ``spark.checkpoint.dir``; where that isn't set, on one machine, below a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, *by: str) -> DataFrame:
    """``df`` written below a shared path (a folder for each value of ``by``) and read again: its lineage is cut, a lost
    executor costs a reread."""
    path = shared_path(df.sparkSession, what)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder's end, in whatever store it is; one that isn't there is no error."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
