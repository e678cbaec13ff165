"""Folders that driver and executors share, for what is written and read again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset a local session gets one of its
    own; a cluster has none that all its machines share, which is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        given = "file://" + os.path.join(tempfile.gettempdir(), "sparkveil-shared")
    return given.rstrip("/")


def place(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder in the shared one, which goes with the driver's JVM, on whatever file system."""
    path = f"{shared_dir(spark)}/sparkveil-{name}-{uuid.uuid4().hex}"
    system, where = place(spark, path)
    system.mkdirs(where)
    system.deleteOnExit(where)
    return path
