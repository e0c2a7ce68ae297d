"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", own := f"file://{tempfile.mkdtemp(prefix='lithograph-')}")
    return own


#: Folders that this application has named and not removed, by its id.
_HELD: dict[str, set[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/lithograph/{name}-{uuid.uuid4().hex}"
    _HELD.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def clear(spark: SparkSession) -> int:
    """Remove every table that operators of this application have left; to be called when their results have been read or written.  Returns how many."""
    held = list(_HELD.get(spark.sparkContext.applicationId, ()))
    for path in held:
        delete(spark, path)
    return len(held)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever store it is in."""
    _HELD.get(spark.sparkContext.applicationId, set()).discard(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from the files: its lineage ends here, on every executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a stashed table that nothing reads any more."""
    delete(df.sparkSession, df.stash_path)
