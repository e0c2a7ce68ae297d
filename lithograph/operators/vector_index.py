"""Nearest vectors by cosine from an index of cells around centroids.

Centroids come from a bounded sample: ``SAMPLE_ROWS`` rows and ``SAMPLE_VALUES`` numbers at most,
those with the least hashes of their ids, clustered by k-means on unit vectors in the driver.
Every row is assigned to its nearest centroid and written to its cell's folder; a cell with more
than ``BLOCK_ROWS`` rows is several blocks, however many rows share a vector.

A search ranks the centroids for each query and scores the rows of the first ``probes`` cells
exactly.  How many suffice is measured when the index is made: for a bounded set of rows as
queries, against all rows, the ranks of the cells that hold their true neighbours say what share
of those each number of probes would find, and the least number that finds ``target`` is kept.
``probes=None`` reads every cell: the exact scan, whatever the index says.

Rows with a null vector or id are left out.  A zero vector has no cosine and comes last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lithograph.functions import files as fs
from lithograph.functions.storage import cut

#: What is written, told in the names of kept folders: another form has another number.
FORMAT = 2
SAMPLE_ROWS, SAMPLE_VALUES = 65536, 1 << 23
#: Centroids at most, and numbers in them (16 MB), as tasks hold them all.
MOST_CELLS, CELL_VALUES = 4096, 1 << 22
BLOCK_ROWS = 32768
#: Rows by which probes are measured.
TUNING_ROWS = 256
FOUND = "query long, vec_id long, cell int, score double"


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(size > 0, size, 1.0)


def centroids(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Directions of k clusters; the first rows begin, and a cluster that is left empty keeps its direction."""
    rows = _unit(sample)
    now = rows[:k].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(part @ now.T, axis=1) for part in np.array_split(rows, max(1, len(rows) // 4096))]) if len(rows) else np.zeros(0, int)
        sums = np.zeros_like(now)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        after = np.where(size > 0, sums / np.where(size > 0, size, 1.0), now)
        if np.allclose(after, now):
            break
        now = after
    return now


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    folder: str

    @cached_property
    def facts(self) -> dict:
        return fs.read_json(self.spark, f"{self.folder}/facts.json")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/rows")

    @cached_property
    def centroids(self) -> np.ndarray:
        """Directions of the cells, a row each: ``CELL_VALUES`` numbers at most."""
        return matrix(self.spark.read.parquet(f"{self.folder}/centroids").orderBy("cell").select("vector").toArrow()["vector"])

    def near_cells(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query, vector, cell, place): the first ``probes`` cells of each query."""
        held = self.centroids

        def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                asked = _unit(matrix(batch["vector"]))
                near = np.argsort(-(asked @ held.T), axis=1, kind="stable")[:, :probes] if len(asked) else np.zeros((0, 1), int)
                at = np.repeat(np.arange(len(batch)), near.shape[1])
                yield pa.record_batch({"query": batch["query"].take(pa.array(at)), "vector": batch["vector"].take(pa.array(at)), "cell": pa.array(near.ravel().astype(np.int32)), "place": pa.array(np.tile(np.arange(near.shape[1]), len(batch)).astype(np.int32))})

        return queries.select("query", "vector").mapInArrow(ranked, "query long, vector array<double>, cell int, place int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, keep: Column | None = None) -> DataFrame:
        """(query, rank, vec_id, score, cell) of the k nearest rows of each query (query, vector); ties by id.

        ``probes=None`` is the exact scan.  ``keep`` filters rows before they are scored.
        """
        asked = queries.select(F.col("query").cast("long").alias("query"), F.col("vector").cast("array<double>").alias("vector"))
        blocks = self.rows().select("cell", "block").distinct()
        if probes is None:
            # A stated query set against all rows: each query goes to every block.
            numbers = blocks.agg(F.collect_list(F.struct("cell", "block")).alias("all"))
            wanted = asked.join(numbers, F.lit(True)).select("query", "vector", F.inline("all"))
        else:
            wanted = self.near_cells(asked, probes).join(blocks, "cell").select("query", "vector", "cell", "block")
        rows = self.rows() if keep is None else self.rows().where(keep)

        def best(key, held: pa.Table, wished: pa.Table) -> pa.Table:
            if not held.num_rows or not wished.num_rows:
                return pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "cell": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})
            held = held.sort_by("vec_id")
            ids, a, b = held["vec_id"].to_numpy(), matrix(held["embedding"]), matrix(wished["vector"])
            sizes = np.linalg.norm(a, axis=1)
            name, out = wished["query"].to_numpy(), []
            for lo in range(0, len(b), 256):
                part = b[lo:lo + 256]
                product = (part @ a.T) / np.where(sizes > 0, sizes, np.nan) / np.where((own := np.linalg.norm(part, axis=1)) > 0, own, np.nan)[:, None]
                order = np.argsort(-product, axis=1, kind="stable")[:, :k]
                at = np.repeat(np.arange(len(part)), order.shape[1])
                out.append((name[lo + at], ids[order.ravel()], product[at, order.ravel()]))
            score = np.concatenate([x[2] for x in out])
            return pa.table({"query": np.concatenate([x[0] for x in out]), "vec_id": np.concatenate([x[1] for x in out]), "cell": pa.array(np.full(len(score), key[0].as_py(), np.int32)), "score": pa.array(score, mask=np.isnan(score))})

        cell = ["cell", "block"]
        found = rows.select("vec_id", "embedding", *cell).groupBy(*cell).cogroup(wanted.groupBy(*cell)).applyInArrow(best, FOUND)
        order = W.partitionBy("query").orderBy(F.desc_nulls_last("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "vec_id", "score", "cell")

    def near(self, vector: list[float], k: int, probes: int | None = None, keep: Column | None = None) -> DataFrame:
        """(rank, vec_id, score) for one vector, from the folders of its cells alone."""
        probes = self.facts["probes"] if probes is None else probes
        order = np.argsort(-(self.centroids @ np.array(vector, float)), kind="stable")[:probes]
        rows = self.rows().where(F.col("cell").isin([int(c) for c in order]))
        rows = rows if keep is None else rows.where(keep)
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
        asked = F.array(*map(F.lit, map(float, vector)))
        score = F.try_divide(dot("embedding", asked), F.sqrt(dot("embedding", F.transform("embedding", lambda x: x.cast("double")))) * F.lit(float(np.linalg.norm(vector))))
        top = rows.select("vec_id", score.alias("score")).orderBy(F.desc_nulls_last("score"), "vec_id").limit(k)
        return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("score"), "vec_id")))

    def recall(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """One row (queries, k, probes, recall): what share of the true neighbours a search finds."""
        probes = self.facts["probes"] if probes is None else probes
        true, found = cut(self.search(queries, k)), self.search(queries, k, probes)
        hit = true.join(found.select("query", "vec_id"), ["query", "vec_id"], "left_semi").agg(F.count("*").alias("hits"))
        return true.agg(F.countDistinct("query").alias("queries"), F.count("*").alias("n")).crossJoin(hit).select("queries", F.lit(k).alias("k"), F.lit(probes).alias("probes"), F.try_divide("hits", "n").alias("recall"))


def build(vectors: DataFrame, folder: str, k: int = 10, target: float = 0.95, cells: int | None = None, vec_id: str = "vec_id", embedding: str = "embedding") -> VectorIndex:
    """Write the index of all rows of ``vectors``; other columns stay with them."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).withColumn("vec_id", F.col(vec_id).cast("long")).withColumn("embedding", F.col(embedding))
    rows = cut(rows)
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // max(width, 1)))
    cells = max(1, min(cells or round(math.sqrt(n)), MOST_CELLS, CELL_VALUES // max(width, 1), max(n, 1)))
    sample = matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("embedding").toArrow()["embedding"])
    held = centroids(sample, cells) if len(sample) else np.zeros((1, width))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.argmax(_unit(matrix(batch["embedding"])) @ held.T, axis=1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32))], names=[*batch.schema.names, "cell"])

    dealt = cut(rows.mapInArrow(assigned, StructType([*rows.schema.fields, StructField("cell", IntegerType())])))
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_blocks"))
    blocked = dealt.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("_blocks")).cast("int")).drop("_blocks")
    blocked.repartition("cell", "block").write.mode("overwrite").partitionBy("cell").parquet(f"{folder}/rows")
    index = VectorIndex(spark, folder)
    spark.createDataFrame(list(enumerate(held.tolist())), "cell int, vector array<double>").write.mode("overwrite").parquet(f"{folder}/centroids")
    facts = {"rows": n, "cells": len(held), "target": target}
    probes = len(held)
    if n:
        asked = rows.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(TUNING_ROWS).select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("vector"))
        asked = cut(asked)
        true = index.search(asked, k).select("query", "cell").toPandas()  # k rows for each of a bounded number
        ask = asked.toPandas()
        order = np.argsort(-(_unit(np.array(ask["vector"].tolist(), float)) @ held.T), axis=1, kind="stable")
        rank = {(q, c): place for q, line in zip(ask["query"], order) for place, c in enumerate(line)}
        places = np.sort([rank[q, c] for q, c in zip(true["query"], true["cell"])])
        probes = int(places[min(len(places) - 1, math.ceil(target * len(places)) - 1)]) + 1
    fs.publish_json(spark, f"{folder}/facts.json", facts | {"probes": probes})
    return index


def opened(vectors: DataFrame, folder: str, **how) -> VectorIndex:
    """The index in ``folder``, made if it is not there."""
    if not fs.names(vectors.sparkSession, folder).count("facts.json"):
        build(vectors, folder, **how)
    return VectorIndex(vectors.sparkSession, folder)
