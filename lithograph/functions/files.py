"""Small files and folders through Hadoop's file system, in whatever store they are."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import SparkSession


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    system, path = _path(spark, folder)
    return sorted(s.getPath().getName() for s in system.listStatus(path)) if system.exists(path) else []


def publish_json(spark: SparkSession, name: str, value) -> bool:
    """Write a small object so that it is there whole or not at all; false where that name is taken."""
    system, path = _path(spark, name)
    if system.exists(path):
        return False
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{name}.draft")
    out = system.create(draft, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()
    return bool(system.rename(draft, path))


def write_bytes(spark: SparkSession, name: str, raw: bytes) -> None:
    system, path = _path(spark, name)
    out = system.create(path, True)
    out.write(bytearray(raw))
    out.close()


def read_json(spark: SparkSession, name: str):
    system, path = _path(spark, name)
    stream = system.open(path)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def remove(spark: SparkSession, name: str) -> bool:
    """Whether there was anything to remove."""
    system, path = _path(spark, name)
    return bool(system.delete(path, True))


def fingerprint(table) -> str:
    """Of the files that a table is read from: their names, sizes and times."""
    spark, told = table.sparkSession, []
    for name in sorted(table.inputFiles()):
        system, path = _path(spark, name)
        status = system.getFileStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(name)))
        told.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(told).encode()).hexdigest()
