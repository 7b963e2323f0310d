"""The folder that all executors share: written tables and checkpoints live there."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset and one machine runs everything."""
    context = spark.sparkContext
    if where := context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not (where := getattr(context, "_tessella_dir", None)):
        where = context._tessella_dir = "file://" + os.path.join(tempfile.gettempdir(), f"tessella-{os.getpid()}")
        delete_at_exit(spark, where)
    return where


def _path(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store that Spark can reach."""
    files, where = _path(spark, path)
    files.delete(where, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Removes the folder when the driver ends."""
    files, where = _path(spark, path)
    files.deleteOnExit(where)


def fresh(columns: list[str], name: str) -> str:
    """name, or name with underscores before it, so that no column has it (whatever its case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
