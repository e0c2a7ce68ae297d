"""BM25 from an inverted index that is kept as tables, so that a query reads the blocks of its words and no text.

Documents are dealt to cells by the hash of their id, about ``cell_docs`` to each; the postings
of a word in a cell are one row (word, cell, postings, df, most, least): its documents with counts
and sizes, their number, the largest count and the smallest size.  Texts are shuffled once, by cell;
words are counted and blocks made within a cell's task.  Each file is sorted by word and cell, so
a filter on words reads one row group of a file.  A word that every document holds has
as many rows as there are cells; none is large.

A query takes two steps.  From ``most`` and ``least`` alone each cell gets the score that no
document of it can exceed.  The cells with the highest bounds are scored; the k-th score found
is one that a document must reach, so of the other cells only those whose bound reaches it are
read.  The result is exact.

Words are runs of anything but ASCII white space.  Rows with the same id are one document; null
texts are empty.  A negative idf becomes ``epsilon`` times the average idf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions import files as fs
from lithograph.functions.storage import cut

#: What is written, told in the names of kept folders: another form has another number.
FORMAT = 2
CELL_DOCS = 4096
#: Files that an index is written in at most.
MOST_TASKS = 4096
#: Cells that are scored first.
FIRST_CELLS = 8
BLANKS = r"[ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class KeywordIndex:
    spark: SparkSession
    folder: str

    @cached_property
    def facts(self) -> dict:
        return fs.read_json(self.spark, f"{self.folder}/facts.json")

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/blocks")

    def words(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/words")

    def weights(self, terms: list[str], epsilon: float) -> dict[str, float]:
        """The idf of each of a query's words that the index holds."""
        facts = self.facts
        held = {r.word: r.df for r in self.words().where(F.col("word").isin(terms)).collect()}
        idf = {w: math.log(facts["documents"] - df + 0.5) - math.log(df + 0.5) for w, df in held.items()}
        return {w: x if x >= 0 else epsilon * facts["mean_idf"] for w, x in idf.items()}

    def bounds(self, weights: dict[str, float], k1: float, b: float) -> DataFrame:
        """(cell, bound): what no document of a cell can exceed; postings are not read."""
        rows = self.blocks().where(F.col("word").isin(list(weights))).select("word", "cell", "most", "least")
        part = _weight(weights) * _gain(F.col("most"), F.col("least"), self.facts["mean_size"], k1, b)
        return rows.groupBy("cell").agg(F.sum(F.greatest(part, F.lit(0.0))).alias("bound"))

    def scores(self, weights: dict[str, float], blocks: DataFrame, k1: float, b: float) -> DataFrame:
        """(doc_id, score) of all documents of some blocks."""
        rows = blocks.select("word", F.inline("postings"))
        part = _weight(weights) * _gain(F.col("tf"), F.col("size"), self.facts["mean_size"], k1, b)
        return rows.groupBy("doc_id").agg(F.sum(part).alias("score"))

    def top_k(self, query: str, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, first: int = FIRST_CELLS) -> DataFrame:
        """(doc_id, score) of the k best documents that hold a word of the query; ties by id."""
        weights = self.weights(sorted(set(query.split())), epsilon)
        best = lambda rows: rows.where("score <> 0").orderBy(F.desc("score"), "doc_id").limit(k)
        mine = self.blocks().where(F.col("word").isin(list(weights)))
        if not weights:
            return self.scores({"": 0.0}, mine, k1, b).limit(0)
        bounds = cut(self.bounds(weights, k1, b))
        lead = [r.cell for r in bounds.orderBy(F.desc("bound"), "cell").limit(first).collect()]
        found = cut(best(self.scores(weights, mine.where(F.col("cell").isin(lead)), k1, b)))
        n, reach = found.agg(F.count("*"), F.min("score")).first()
        more = bounds.where(~F.col("cell").isin(lead))
        if n == k:  # a sum of parts in another order may differ in its last digits
            more = more.where(F.col("bound") >= reach - 1e-9 * abs(reach))
        rest = self.scores(weights, mine.join(more.select("cell"), "cell", "left_semi"), k1, b)
        return best(found.unionByName(rest))


def _weight(weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for word, weight in weights.items():
        out = F.when(F.col("word") == word, F.lit(weight)).otherwise(out)
    return out


def _gain(tf: Column, size: Column, mean: float, k1: float, b: float) -> Column:
    f = tf.cast("double")
    return f * (k1 + 1) / (f + k1 * (1 - b + b * size / (mean or 1.0)))


def build(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", cell_docs: int = CELL_DOCS) -> KeywordIndex:
    """Write the index of a table of texts, which is read once."""
    spark = docs.sparkSession
    n = docs.select(doc_id).distinct().count()
    cells = 1 << max(0, math.ceil(math.log2(max(n, 1) / cell_docs)))
    cell = F.pmod(F.xxhash64(doc_id), F.lit(cells)).cast("int")
    # All that follows groups by cell and more, so rows that lie by cell are not shuffled again.
    tasks = max(spark.sparkContext.defaultParallelism, min(cells, MOST_TASKS))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), cell.alias("cell")).repartition(tasks, "cell")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), BLANKS), lambda w: w != "")
    tf = rows.select("cell", "doc_id", F.explode(words).alias("word")).groupBy("cell", "doc_id", "word").agg(F.count("*").cast("int").alias("tf"))
    # The size of a document is the sum of its counts.
    sized = tf.withColumn("size", F.sum("tf").over(W.partitionBy("cell", "doc_id")).cast("int"))
    grouped = sized.groupBy("cell", "word").agg(F.sort_array(F.collect_list(F.struct("doc_id", "tf", "size"))).alias("postings"), F.count("*").alias("df"), F.max("tf").alias("most"), F.min("size").alias("least"), F.sum("tf").alias("occurrences"))
    grouped.sortWithinPartitions("word", "cell").write.mode("overwrite").parquet(f"{folder}/blocks")
    counts = spark.read.parquet(f"{folder}/blocks").groupBy("word").agg(F.sum("df").alias("df"), F.sum("occurrences").alias("occurrences"))
    counts.repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{folder}/words")
    mean = (spark.read.parquet(f"{folder}/words").agg(F.sum("occurrences")).first()[0] or 0) / max(n, 1)
    idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    mean_idf = spark.read.parquet(f"{folder}/words").agg(F.avg(idf)).first()[0]
    fs.publish_json(spark, f"{folder}/facts.json", {"documents": n, "mean_size": float(mean or 0), "mean_idf": mean_idf or 0.0, "cells": cells})
    return KeywordIndex(spark, folder)


def opened(docs: DataFrame, folder: str, **how) -> KeywordIndex:
    """The index in ``folder``, made if it is not there; what says whether it is, is written last."""
    if not fs.names(docs.sparkSession, folder).count("facts.json"):
        build(docs, folder, **how)
    return KeywordIndex(docs.sparkSession, folder)
