"""Folders of the store that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without one the warehouse, and a temporary folder for a local session only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    local = spark.sparkContext.master.split("[")[0] == "local"
    return tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir")


def new_folder(spark: SparkSession, name: str) -> str:
    """The name of a folder that doesn't exist yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no such folder."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)
