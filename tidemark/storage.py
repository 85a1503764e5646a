"""Folders that every executor can reach, and lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    already_set = spark.sparkContext.getCheckpointDir()
    if already_set:
        return already_set
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, removed by the file system when the JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    file_system.deleteOnExit(hadoop_path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """Write the frame once as a Parquet table and read it from there.

    Later reads see the very same rows, need no earlier stage again after an executor is lost,
    and still prune columns.
    """
    path = new_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
