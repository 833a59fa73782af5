"""Versioned tables: a refresh is written beside the old version and takes its place by one small pointer file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current"


def _files(spark: SparkSession, path: str):
    """The file system of a path, and its Path class."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of the version that is read now."""
    files, path_of = _files(spark, path)
    names = sorted((s.getPath().getName() for s in (files.listStatus(path_of(path)) if files.exists(path_of(path)) else [])), reverse=True)
    for name in names:  # the greatest pointer; a version whose pointer was never written doesn't count
        if name.startswith(_POINTER):
            return f"{path}/{name.split('-', 1)[1]}"
    return None


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write df as a new version and point to it once all of it is there; the `keep` newest versions stay for readers.

    The job may fail or lose its driver at any time: until the pointer is renamed into place the old version is the current one.
    One writer at a time.
    """
    spark = df.sparkSession
    files, path_of = _files(spark, path)
    number = 1 + max((int(n) for n in _numbers(files, path_of, path)), default=0)
    version = f"v{number:010d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/{version}")
    made = path_of(f"{path}/_making-{version}")
    files.create(made).close()
    if not files.rename(made, path_of(f"{path}/{_POINTER}{number:010d}-{version}")):
        raise OSError(f"the new version of {path} could not be pointed to")
    pointers = sorted(s.getPath().getName() for s in files.listStatus(path_of(path)) if s.getPath().getName().startswith(_POINTER))
    for name in pointers[:-keep]:
        files.delete(path_of(f"{path}/{name}"), False)
        files.delete(path_of(f"{path}/{name.split('-', 1)[1]}"), True)
    return f"{path}/{version}"


def _numbers(files, path_of, path: str) -> list[str]:
    if not files.exists(path_of(path)):
        return []
    names = (s.getPath().getName() for s in files.listStatus(path_of(path)))
    return [n[1:11] for n in names if n.startswith("v") and n[1:11].isdigit()]


def read_version(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version, or None where nothing was published."""
    at = current_version(spark, path)
    return None if at is None else spark.read.parquet(at)
