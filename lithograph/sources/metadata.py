"""Metadata and reports in files: written whole, read with a schema, read if they are there, kept between runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

METADATA_SCHEMA = (
    "file_path string, package string, imports array<string>, annotations array<string>, classes array<string>, "
    "interfaces array<string>, enums array<string>, methods array<string>, lines_of_code int, content_hash string"
)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def delete(spark: SparkSession, path: str) -> bool:
    """Whether there was anything to remove."""
    system, target = _file_system(spark, path)
    return system.delete(target, True)


def save_metadata(rows: DataFrame, path: str) -> None:
    """Metadata rows as JSON, one object a line; what was there is replaced."""
    names = StructType.fromDDL(METADATA_SCHEMA).fieldNames()
    rows.select(*names).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_metadata(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Metadata rows from JSON lines, or from an array (``multi_line``); a missing file is an error, missing lists are empty."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    rows = spark.read.schema(METADATA_SCHEMA).option("multiLine", str(multi_line).lower()).json(path)
    empty = F.array().cast("array<string>")
    return rows.select(*(F.coalesce(F.col(f.name), empty).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in rows.schema))


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; none where the file is missing, nulls for what cannot be read."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines of a text; none where the file is missing."""
    return spark.read.text(path) if exists(spark, path) else spark.createDataFrame([], "value string")


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame], refresh: bool = False) -> tuple[DataFrame, bool]:
    """A result that is kept in a folder, and whether it was there: made and written the first time, read after that."""
    if refresh:
        delete(spark, path)
    kept = exists(spark, f"{path}/_SUCCESS")
    if not kept:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), kept


def save_lines(lines: DataFrame, path: str, keys: list[str], column: str = "line") -> None:
    """A text of any size, as files in the order of ``keys``."""
    lines.repartitionByRange(*(F.col(k) for k in keys)).sortWithinPartitions(*keys).select(column).write.mode("overwrite").option("lineSep", "\n").text(path)
