"""Keyword and vector retrieval: BM25, cosine top-k, maximal marginal relevance, rank fusion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.storage import cut


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine_top_k(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """vectors (vec_id, embedding) closest to the single row of ``query`` (embedding); ties by id."""
    one = F.broadcast(query.select(F.col("embedding").alias("_q")))
    score = F.try_divide(dot("embedding", "_q"), norm("embedding") * norm("_q"))
    return vectors.crossJoin(one).withColumn("score", score).orderBy(F.desc("score"), "vec_id").limit(k).drop("_q")


def mmr(candidates: DataFrame, k: int, balance: float = 0.6) -> list[tuple]:
    """Greedy maximal marginal relevance over fetch_k candidates (a bounded top-k): [(rank, vec_id)]."""
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.score) for r in candidates.collect()]
    unit = {i: [x / (math.sqrt(sum(v * v for v in vec)) or 1.0) for x in vec] for i, vec, _ in rows}
    score = {i: s for i, _, s in rows}
    chosen: list = []
    while len(chosen) < k and len(chosen) < len(rows):
        def worth(i):
            near = max((sum(a * b for a, b in zip(unit[i], unit[c])) for c in chosen), default=0.0)
            return balance * score[i] - (1 - balance) * near

        chosen.append(min((i for i in score if i not in chosen), key=lambda i: (-round(worth(i), 12), i)))
    return list(enumerate(chosen, 1))


def bm25_top_k(docs: DataFrame, query: str, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """(doc_id, score) by BM25 over white-space words; negative idf becomes epsilon * average idf.

    Only the query's words are counted per document; sizes are one grouped pass.  The average
    idf, over all words, is worked out only if a query word needs it.
    """
    terms = sorted(set(query.split()))
    # Words with two blanks between them: a word is counted as a replaced text, within compiled code.
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace("text", r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", ""), r"[ \t\n\x0B\f\r]+", "  "), F.lit(" "))
    count = lambda t: ((F.length("spaced") - F.length(F.replace(F.col("spaced"), F.lit(t), F.lit("")))) / len(t)).cast("int")
    size = F.when(F.length("spaced") > 2, count("  ") + 1).otherwise(0)
    tf = docs.select("doc_id", spaced.alias("spaced")).select("doc_id", size.alias("size"), *(count(f" {t} ").alias(f"tf{i}") for i, t in enumerate(terms)))
    tf = cut(tf)  # a few numbers a document, from one reading of the texts
    row = tf.agg(F.count("*").alias("n"), F.avg("size").alias("avg"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms)))).first()
    idf = [math.log(row["n"] - row[f"df{i}"] + 0.5) - math.log(row[f"df{i}"] + 0.5) for i in range(len(terms))]
    if any(x < 0 for x in idf):
        words = F.array_distinct(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
        df = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
        mean = df.agg(F.avg(F.log(F.lit(row["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
        idf = [epsilon * mean if x < 0 else x for x in idf]
    score = F.lit(0.0)
    for i, weight in enumerate(idf):
        f = F.col(f"tf{i}").cast("double")
        score = score + weight * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("size") / row["avg"]))
    return tf.select("doc_id", score.alias("score")).where("score <> 0").orderBy(F.desc("score"), "doc_id").limit(k)


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], key: str, c: int = 60) -> DataFrame:
    """(key, score) from ranked lists (key, rank), each with a weight: sum of weight / (c + rank)."""
    parts = [df.select(key, (F.lit(weight) / (c + F.col("rank"))).alias("part")) for df, weight in lists]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy(key).agg(F.sum("part").alias("score"))


def ranked(df: DataFrame, key: str) -> DataFrame:
    """Ranks of a short scored list."""
    return df.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def class_filter(chunks: DataFrame, needle: str, column: str, fallback: int = 4) -> DataFrame:
    """Rows whose column holds the needle, whatever the case; else the first few by id."""
    hit = chunks.where(F.lower(column).contains(needle.lower()))
    return chunks.orderBy(chunks.columns[0]).limit(fallback) if hit.isEmpty() else hit




def normalised(vectors: DataFrame) -> DataFrame:
    """Vectors of length one; a zero vector stays as it is."""
    size = norm("embedding")
    return vectors.withColumn("embedding", F.transform("embedding", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(x.cast("double"))))


def hybrid(docs: DataFrame | None, vectors: DataFrame, query_text: str, query_vector: DataFrame, k: int = 8, weights=(0.4, 0.6)) -> DataFrame:
    """(id, score): words and vectors fused by rank; vectors alone where there are no documents."""
    dense = ranked(cosine_top_k(vectors, query_vector, k), "vec_id").withColumnRenamed("vec_id", "id")
    if docs is None or docs.isEmpty():
        return reciprocal_rank_fusion([(dense, 1.0)], "id")
    words = ranked(bm25_top_k(docs, query_text, k), "doc_id").withColumnRenamed("doc_id", "id")
    return reciprocal_rank_fusion([(words, weights[0]), (dense, weights[1])], "id")


def file_name(path) -> Column:
    return F.substring_index(F.substring_index(path, "\\", -1), "/", -1)


def explain(chunks: DataFrame, name: str, fallback: int = 4) -> DataFrame:
    """Chunks whose class or file name holds the name, whatever the case; else the first few by ``rank``.

    Chunks of one rank come in an order of their own: other types of a file before the one that it is named after, then by name.
    """
    needle = name.lower()
    fits = F.lower(F.coalesce("class_name", F.lit(""))).contains(needle) | F.lower(file_name("file_path")).contains(needle)
    hit = cut(chunks.where(fits))  # one reading tells whether there are any, and which
    named = F.coalesce(F.substring_index(file_name("file_path"), ".", 1) == F.col("class_name"), F.lit(False))
    return chunks.orderBy("rank", named, "class_name", "chunk_id").limit(fallback) if hit.isEmpty() else hit


def labelled(chunks: DataFrame) -> DataFrame:
    """(rank, source, block): each chunk of a ranked list under its label: method, class, or file alone."""
    name = file_name("file_path")
    label = F.when(F.coalesce("method", F.lit("")) != "", F.concat(name, F.lit(" >> "), F.coalesce("class_name", F.lit("")), F.lit("."), "method", F.lit("()"))).when(F.coalesce("class_name", F.lit("")) != "", F.concat(name, F.lit(" >> "), "class_name")).otherwise(name)
    return chunks.select("rank", name.alias("source"), F.concat(F.lit("--- ["), F.col("rank").cast("string"), F.lit("] "), label, F.lit(" ["), "chunk_type", F.lit("] ---\n"), "page_content").alias("block"))


def sources(blocks: DataFrame) -> DataFrame:
    """(source, rank): each source once, where it first comes."""
    return blocks.groupBy("source").agg(F.min("rank").alias("rank"))
