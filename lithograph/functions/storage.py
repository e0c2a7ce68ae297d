"""Cutting lineage between the rounds of an iterative operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir; make one only in local runs that name none."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    found = context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lithograph-")
    context.setCheckpointDir(found)


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame) -> DataFrame:
    """``df`` as compressed columns in the shared checkpoint folder: for wide rows that are made once and read in part, or more than once."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_folder(spark: SparkSession, name: str) -> str:
    """A folder below the shared checkpoint folder that stays the same for the same name, for what is made once and read again."""
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/kept/{name}"
