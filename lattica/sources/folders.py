"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local folder, but only if the executors run in this process."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "lattica-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one."""
    return f"{shared(spark)}/lattica-{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str) -> tuple:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """Has a folder that exists deleted when the driver's process ends, on whatever store it is."""
    store, own = _store(spark, path)
    store.deleteOnExit(own)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    store, own = _store(spark, path)
    return [x.getPath().getName() for x in store.listStatus(own)] if store.exists(own) else []


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, with its schema; deleted when the driver's process ends."""
    path = new(df.sparkSession, name)
    df.write.parquet(path)
    deleted_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The table of a loop, written anew in each round; the one before goes as soon as the new one is whole."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        path, before = new(self.spark, self.name), self.path
        df.write.parquet(path)
        deleted_at_exit(self.spark, path)
        self.path = path
        if before:
            store, own = _store(self.spark, before)
            store.delete(own, True)
        return self.spark.read.schema(df.schema).parquet(path)
