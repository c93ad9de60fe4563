"""Folders for intermediate tables, on storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for one intermediate table, below spark.checkpoint.dir; it is removed when the driver's
    JVM ends. Where that is unset, a folder below the warehouse is taken, but only on one machine: elsewhere
    executors might not share it."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir") + "/_stages"
    path = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(where)
    return path


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df, written to a folder of its own and read again: what is used several times is made once."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
