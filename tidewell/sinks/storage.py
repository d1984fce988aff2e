"""Folder operations on whatever file system a path belongs to."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def child_names(spark: SparkSession, path: str) -> list[str]:
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    return [status.getPath().getName() for status in fs.listStatus(target)]


def age_in_seconds(spark: SparkSession, path: str) -> float:
    fs, target = _file_system(spark, path)
    return time.time() - fs.getFileStatus(target).getModificationTime() / 1000


def size_in_bytes(spark: SparkSession, path: str) -> int:
    fs, target = _file_system(spark, path)
    return fs.getContentSummary(target).getLength()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A folder of small files under a second name; a folder that is not there gives none."""
    fs, place = _file_system(spark, source)
    if fs.exists(place):
        to_fs, to = _file_system(spark, target)
        to_fs.mkdirs(to.getParent())
        util = spark._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(fs, place, to_fs, to, False, spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target) and fs.delete(target, True)
