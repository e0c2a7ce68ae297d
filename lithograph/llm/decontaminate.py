"""Benchmark decontamination: a prefix-filtered set join on built-in functions.

A benchmark item is its windows of ``window`` consecutive words (a shorter item is one
window).  A window occurs in a document if its words occur there in a row.

1.  Windows are sets of shingles (runs of 4 words, or of the whole window if it is shorter).
    How often each shingle of the benchmark occurs in the corpus is counted first.
2.  Shingles are ordered by that rarity.  A window that occurs brings its rarest shingle
    along, so its prefix is that one; windows whose rarest shingle does not occur are done.
    Only the prefix shingles are joined with the corpus; matches keep their place and the
    few words around it.
3.  Length and place bounds drop candidates that would reach over either end of the text;
    the words of the rest are compared one by one.

Shingles are broadcast in blocks of ``BLOCK_SHINGLES`` at most (8 bytes each); a larger
benchmark takes more passes over the corpus, and no larger broadcast.

Defined results
    * null text or item: no words; such items match nothing;
    * items that repeat an id count once, items with a null id hit words but have no id to list;
    * repeated rows and equal texts have equal results, each its own row;
    * extra columns are ignored; empty tables give no hits, or an empty result.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm.chunks import text_sha
from lithograph.llm.storage import stash

#: Words of a shingle, and shingles of the benchmark in one broadcast (16 MB as a hash map).
SHINGLE = 4
BLOCK_SHINGLES = 1 << 20

#: What separates words, before letters A-Z are lowered.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words in their own case; only the ends of a split can be empty."""
    parts = F.split(F.coalesce(text, F.lit("")), BREAK)
    first = (F.element_at(parts, 1) == "").cast("int")
    last = (F.element_at(parts, -1) == "").cast("int")
    return F.slice(parts, first + 1, F.greatest(F.size(parts) - first - last, F.lit(0)))


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def with_shingles(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with ``shingles``: hashes of every n consecutive ``words``."""
    first = F.slice("words", F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(0)))
    return rows.withColumn("shingles", F.transform(first, lambda w, i: F.xxhash64(w, *(F.get(F.col("words"), i + k) for k in range(1, n)))))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """(win, length, size, items, win_id): distinct windows and the ids of the items that hold them."""
    words = items.select("item_id", words_of(lowered(F.col("text"))).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    wins = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(window)))).alias("win"))
    grouped = wins.groupBy("win").agg(F.collect_set("item_id").alias("items"))
    return grouped.select("win", F.size("win").alias("length"), F.least(F.size("win"), F.lit(SHINGLE)).alias("size"), "items", F.monotonically_increasing_id().alias("win_id"))


def occurrences(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sha, start, length, win_id) for every place where a window occurs, and the windows."""
    spark = docs.sparkSession
    wins = stash(windows_of(items, window), "windows")
    sizes = sorted(r[0] for r in wins.select("size").distinct().collect())  # at most SHINGLE numbers
    out = None
    for n in sizes:
        own = wins.where(F.col("size") == n)
        tokens = with_shingles(own.select("win_id", F.col("win").alias("words")), n).select("win_id", F.posexplode("shingles").alias("offset", "token"))
        tokens = stash(tokens, "shingles")
        text = docs.select(F.col(text_col).alias("text")).withColumn("words", words_of(lowered(F.col("text"))))
        text = with_shingles(text, n)
        # Not a plain explode: its inferred filter on the array would be worked out again.
        every = text.select(F.explode_outer("shingles").alias("token"))
        counts = _union(every.join(F.broadcast(block), "token").groupBy("token").agg(F.count("*").alias("matches")) for block in _blocks(tokens))
        rarest = tokens.join(counts, "token").groupBy("win_id").agg(F.count("*").alias("found"), F.min(F.struct("matches", "token", "offset")).alias("r"))
        # A window occurs only if all its shingles do.
        whole = (F.col("length") - n + 1) == F.col("found")
        prefix = rarest.join(own.select("win_id", "win", "length"), "win_id").where(whole).select("win_id", "win", "length", F.col("r.token").alias("token"), F.col("r.offset").alias("offset"))
        prefix = stash(prefix, "prefix")
        places = text.select("text", "words", F.posexplode_outer("shingles").alias("at", "token"))
        begin = F.greatest(F.col("at") + 1 - window, F.lit(0))
        hit = stash(_union(
            places.join(F.broadcast(block), "token").select(text_sha("text").alias("sha"), "token", "at", F.size("words").alias("n_words"), F.slice("words", begin + 1, F.lit(2 * window + n)).alias("around"))
            for block in _blocks(prefix)
        ).distinct(), "matches")
        start = F.col("at") - F.col("offset")
        part = (
            hit.join(prefix, "token")
            .where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
            .where(F.slice("around", start - begin + 1, F.col("length")) == F.col("win"))
            .select("sha", start.cast("int").alias("start"), "length", "win_id")
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "sha binary, start int, length int, win_id long"), wins
    return out, wins


def _blocks(tokens: DataFrame) -> list[DataFrame]:
    """Distinct tokens in tables of BLOCK_SHINGLES, about."""
    blocks = max(1, math.ceil(tokens.select("token").distinct().count() / BLOCK_SHINGLES))
    if blocks == 1:  # a filter would be inferred for the corpus too
        return [tokens.select("token").distinct()]
    return [tokens.where(F.pmod(F.xxhash64("token"), F.lit(blocks)) == b).select("token").distinct() for b in range(blocks)]


def _union(parts) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def contaminated_texts(docs: DataFrame, items: DataFrame, window: int = 10, text_col: str = "text") -> DataFrame:
    """Per hit text (``sha``): the hit word ranges (start, length), n_hit and the sorted ids of items that occur."""
    places, wins = occurrences(docs, items, window, text_col)
    places = stash(places, "places")
    spans = places.select("sha", "start", "length").distinct().groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    # The words that a span adds beyond the furthest end so far.
    reach = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(s["start"] + s["length"] - F.greatest(acc["end"], s["start"]), F.lit(0))).cast("long").alias("hit"),
            F.greatest(acc["end"], s["start"] + s["length"]).alias("end"),
        ),
    )
    spans = spans.withColumn("n_hit", reach["hit"])
    held = places.select("sha", "win_id").distinct().join(wins.select("win_id", F.explode("items").alias("item_id")), "win_id")
    ids = held.groupBy("sha").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    return spans.join(ids, "sha", "left")


def op9_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return _per_document(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _per_document(docs: DataFrame, items: DataFrame) -> DataFrame:
    texts = contaminated_texts(docs, items).select("sha", "n_hit", "item_ids")
    rows = docs.select("doc_id", count_words(F.col("text")).alias("n_words"), text_sha().alias("sha"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return rows.join(texts, "sha", "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

ORACLE_SQL = {
    "op9_benchmark_decontamination": rf"""
WITH i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
v AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[s:s + 9] AS win, len(w[s:s + 9]) AS l FROM v),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, list(x) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS f FROM p),
hit AS (
  SELECT g.doc_id, g.pos, n.l, win.item_id
  FROM g JOIN (SELECT DISTINCT l FROM win) n ON len(g.f) >= n.l JOIN win ON win.l = n.l AND win.win = g.f[1:n.l]),
cover AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + l)) AS x FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (WHERE item_id IS NOT NULL)) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN ids USING (doc_id)""",
}
