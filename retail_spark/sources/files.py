"""Small files of metadata, read and written by the driver on whatever file system a path names."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, where = _located(spark, folder)
    if not system.exists(where):
        return []
    return sorted(entry.getPath().getName() for entry in system.listStatus(where))


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _located(spark, path)
    stream = system.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that must not exist yet; FileExistsError if it does."""
    system, where = _located(spark, path)
    try:
        stream = system.create(where, False)
    except Py4JJavaError as failure:
        if "FileAlreadyExistsException" in failure.java_exception.getClass().getName():
            raise FileExistsError(path) from failure
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    system, where = _located(spark, path)
    system.delete(where, True)
