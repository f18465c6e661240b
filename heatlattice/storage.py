"""Cutting lineage where executors can be lost: tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder if driver and executors are one process, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        sc.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "checkpoints"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table in the shared folder and read again; the table goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    at, fs = _place(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def scratch(spark: SparkSession, suffix: str = "") -> str:
    """A new folder in the shared folder, for files that are no tables; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}{suffix}"
    at, fs = _place(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(table: DataFrame) -> None:
    """Deletes a stored() table that nothing reads any more."""
    at, fs = _place(table.sparkSession, table._stored_at)
    fs.delete(at, True)
