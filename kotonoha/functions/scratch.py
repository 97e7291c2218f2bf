"""Folders for what jobs write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. A temporary one where none is set, in local mode alone: on a cluster the executors would not see it, so that there it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="kotonoha-")


def _folder(spark: SparkSession, path: str) -> tuple:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def scratch(spark: SparkSession) -> str:
    """A new folder name in it. What is written there is removed when the driver ends, as results may be read from it until then."""
    path = f"{scratch_root(spark)}/scratch-{uuid.uuid4().hex}"
    files, folder = _folder(spark, path)
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{path}/data"


def clear(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``scratch`` named, and what it holds, before the driver ends."""
    files, folder = _folder(spark, path.removesuffix("/data"))
    if not folder.getName().startswith("scratch-"):
        raise ValueError(f"not a scratch folder: {path}")
    files.delete(folder, True)
    files.cancelDeleteOnExit(folder)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder and what it holds, if it is there."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names of what a folder holds."""
    files, folder = _folder(spark, path)
    return [status.getPath().getName() for status in files.listStatus(folder)]
