"""Numbering rows in a total order without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.storage import saved


def numbered(df: DataFrame, keys: list[Column], name: str = "place", group: str | None = None) -> DataFrame:
    """``df`` with ``name``: 1, 2, .. in the order of ``keys`` (within ``group``).

    Rows are dealt by ranges of the keys, sorted and written once with their place in the range;
    the ranges' counts (one number a partition and group) tell where each begins.  The ranges are
    told from a sample, for which ``df`` is worked out once more: an expensive one is best saved first.
    """
    lead = [] if group is None else [F.col(group)]
    sorted_ = df.repartitionByRange(*lead, *keys).sortWithinPartitions(*lead, *keys)
    # An id holds the number of a partition, then that of a row in it.
    rows = saved(sorted_.withColumn("_id", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_id", 33))
    counts = rows.groupBy(*lead, "_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    by = W.partitionBy(*lead) if lead else W.partitionBy(F.lit(1))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(by.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    joined = rows.join(F.broadcast(before) if group is None else before, [*([group] if group else []), "_range"])
    return joined.withColumn(name, F.col("_before") + F.col("_id") - F.col("_first") + 1).select(*df.columns, name)
