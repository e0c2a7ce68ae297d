"""Connected components of a distributed edge table (alternating large-star and small-star).

Each round joins edges with the smallest neighbour of one of their ends.  No node's
neighbours are ever gathered: a hub is a grouped minimum and a skewed join, which
adaptive execution splits.  The number of rounds is logarithmic in practice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm.storage import drop, stash


def _star(edges: DataFrame) -> DataFrame:
    """(u, v), v < u, with v replaced by u's smallest neighbour; and v linked to it."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v): label is the smallest node reachable."""
    now = stash(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _fingerprint(now)
    while mark[0]:
        full = _both(now)
        least = full.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = full.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        after = stash(_star(large).where(F.col("u") != F.col("v")).distinct(), "edges")
        drop(now)
        now, before, mark = after, mark, _fingerprint(after)
        if mark == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
