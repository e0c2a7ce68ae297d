"""Text units: hashes, lines, chunks, and set-similarity clones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.storage import cut


def line_count(text) -> Column:
    """Line feeds plus one, as files are measured."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("pos", F.col("pos") + 1)


def fixed_windows(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of ``size`` characters that start every size - overlap; (id, chunk_index, chunk)."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text_col) - overlap) / step) - 1, F.lit(0)).cast("int"))
    return docs.select(id_col, text_col, F.explode(starts).alias("chunk_index")).select(id_col, "chunk_index", F.substring(F.col(text_col), F.col("chunk_index") * step + 1, F.lit(size)).alias("chunk"))


def chunk_id(*parts) -> Column:
    return F.md5(F.concat(*(F.col(p).cast("string") for p in parts)))


#: Sets that meet at one value in one task at most; where more hold it, they meet in blocks of that many.
BLOCK_SETS = 2048


def set_classes(items: DataFrame, key: str, value: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(members, sets): (key, representative, n) of every key with ``least`` distinct values, and the values of representatives.

    Keys with equal sets have the least of them as representative.  A set is told by its size,
    two sums and an exclusive or of hashes of its values, so none is gathered.
    """
    sets = cut(items.select(F.col(key).alias("k"), F.col(value).alias("v")).distinct())
    once, twice = F.xxhash64("v"), F.xxhash64(F.lit(7), "v")
    marks = sets.groupBy("k").agg(F.count("*").alias("n"), F.sum(once.cast("decimal(38,0)")).alias("m1"), F.sum(twice.cast("decimal(38,0)")).alias("m2"), F.bit_xor(once).alias("m3")).where(F.col("n") >= least)
    mark = ["n", "m1", "m2", "m3"]
    marks = cut(marks)
    first = marks.groupBy(*mark).agg(F.min("k").alias("representative"))
    members = cut(marks.join(first, mark).select(F.col("k").alias(key), "representative", "n"))
    chosen = members.where(F.col(key) == F.col("representative")).select(F.col(key).alias("k"), "n")
    return members, cut(sets.join(chosen, "k"))


def _in_blocks(rows: DataFrame, by: str, key: str, block: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice with the columns cell_i and cell_j: any two rows of one value of ``by`` have one cell in common.

    A value of p rows has ceil(p / block) parts; a row goes to all cells of its own part, so a
    cell holds about ``block`` rows of either side however many rows the value has.
    """
    parts = rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    dealt = cut(rows.join(parts, by).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    left = dealt.select("*", F.col("_part").alias("cell_i"), every.alias("cell_j")).drop("_part", "_parts")
    right = dealt.select("*", every.alias("cell_i"), F.col("_part").alias("cell_j")).drop("_part", "_parts")
    return left, right


def similar_sets(items: DataFrame, key: str, value: str, threshold: float, least: int, block: int = BLOCK_SETS) -> tuple[DataFrame, DataFrame]:
    """(pairs, members).  Pairs (a, b, shared, similarity), a < b, of representatives whose distinct values have Jaccard similarity >= threshold.

    Equal sets are one representative and its members (see ``set_classes``).  Exact: values are
    ordered by rarity, and sets that reach the threshold must share one of their first
    n - ceil(threshold n) + 1; only such pairs are compared, by joins over their values.
    """
    members, sets = set_classes(items, key, value, least)
    counts = sets.groupBy("v").agg(F.count("*").alias("_df"))
    ordered = sets.join(counts, "v").withColumn("_k", F.row_number().over(W.partitionBy("k").orderBy("_df", "v")))
    prefix = ordered.where(F.col("_k") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).where("_df > 1").select("k", "v", "n")
    left, right = _in_blocks(prefix, "v", "k", block)
    left, right = left.withColumnsRenamed({"k": "a", "n": "na"}), right.withColumnsRenamed({"k": "b", "n": "nb"})
    met = left.join(right, ["v", "cell_i", "cell_j"]).where("a < b").where((F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold))
    near = cut(met.select("a", "b", "na", "nb").distinct())
    held = sets.select("k", "v")
    both = near.join(held.withColumnRenamed("k", "a"), "a").join(held.withColumnRenamed("k", "b"), ["b", "v"])
    shared = both.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    similarity = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return shared.withColumn("similarity", similarity).where(F.col("similarity") >= threshold).select("a", "b", "shared", "similarity"), members


def all_pairs(pairs: DataFrame, members: DataFrame, key: str, block: int = BLOCK_SETS) -> DataFrame:
    """(a, b, shared, similarity), a < b: every pair of keys that pairs of representatives and their members stand for.

    As many rows as there are pairs; keys with equal sets meet in blocks, so no task holds all of a large class.
    """
    rows = members.select(F.col(key).alias("k"), "representative", "n")
    ca, cb = rows.select(F.col("representative").alias("a"), F.col("k").alias("ka")), rows.select(F.col("representative").alias("b"), F.col("k").alias("kb"))
    apart = pairs.join(ca, "a").join(cb, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "shared", "similarity")
    left, right = _in_blocks(rows, "representative", "k", block)
    same = left.withColumnRenamed("k", "a").join(right.select(F.col("k").alias("b"), "representative", "cell_i", "cell_j"), ["representative", "cell_i", "cell_j"]).where("a < b")
    return apart.unionByName(same.select("a", "b", F.col("n").alias("shared"), F.lit(1.0).alias("similarity")))


def clone_pairs(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(a, b, shared, similarity, pairs): pairs of representatives and how many pairs of keys each stands for; (a, a, ..) for keys with equal sets."""
    copies = members.groupBy("representative", "n").agg(F.count(F.col(key)).alias("copies"))
    ca, cb = copies.select(F.col("representative").alias("a"), F.col("copies").alias("ca")), copies.select(F.col("representative").alias("b"), F.col("copies").alias("cb"))
    apart = pairs.join(ca, "a").join(cb, "b").select("a", "b", "shared", "similarity", (F.col("ca") * F.col("cb")).alias("pairs"))
    same = copies.where("copies > 1").select(F.col("representative").alias("a"), F.col("representative").alias("b"), F.col("n").alias("shared"), F.lit(1.0).alias("similarity"), F.expr("copies * (copies - 1) div 2").alias("pairs"))
    return apart.unionByName(same)
