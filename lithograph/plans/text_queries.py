"""Queries over texts and vectors: hashes, chunks, clones, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.functions.files import fingerprint
from lithograph.functions.order import numbered
from lithograph.functions.storage import kept_folder
from lithograph.operators import keyword_index as keyword
from lithograph.operators import retrieval as R
from lithograph.operators import text as T
from lithograph.operators import vector_index as vectors
from lithograph.operators.relational import top_per_group
from lithograph.plans.tables import Catalog, table

catalog = Catalog()


def documents(spark, sf):
    return table(spark, sf, "documents")


@catalog.add("SELECT md5(text) AS content_hash, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf):
    return documents(spark, sf).groupBy(F.md5("text").alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@catalog.add("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines_of_code, md5(text) AS content_hash FROM documents")
def file_metadata(spark, sf):
    return documents(spark, sf).select("doc_id", T.line_count("text").cast("long").alias("lines_of_code"), F.md5("text").alias("content_hash"))


@catalog.add("SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)")
def chunk_lines_explode(spark, sf):
    return T.lines(documents(spark, sf)).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


_WINDOWS = """SELECT doc_id, CAST(i AS INT) AS chunk_index, substr(text, CAST(i * 1300 + 1 AS BIGINT), 1500) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 200) / 1300.0), 1) AS BIGINT))) AS i FROM documents)"""


@catalog.add(_WINDOWS)
def chunk_fixed_window(spark, sf):
    return T.fixed_windows(documents(spark, sf), 1500, 200)


@catalog.add(f"SELECT md5(CAST(doc_id AS VARCHAR) || 'fallback' || CAST(chunk_index AS VARCHAR)) AS chunk_id, doc_id, chunk_index FROM ({_WINDOWS})")
def chunk_ids(spark, sf):
    chunks = T.fixed_windows(documents(spark, sf), 1500, 200).withColumn("kind", F.lit("fallback"))
    return chunks.select(T.chunk_id("doc_id", "kind", "chunk_index").alias("chunk_id"), "doc_id", "chunk_index")


@catalog.add("SELECT doc_id, md5(text) AS content_hash FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def incremental_anti_hash(spark, sf):
    """What an incremental load still has to index: documents whose hash the indexed ones (those with labels) lack."""
    rows = documents(spark, sf).select("doc_id", F.md5("text").alias("content_hash"))
    indexed = rows.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("content_hash")
    return rows.join(indexed, "content_hash", "left_anti").select("doc_id", "content_hash")


_SETS = """s AS (SELECT DISTINCT doc_id AS k, unnest(string_split(text, chr(10))) AS v FROM documents), z AS (SELECT k, count(*) AS n FROM s GROUP BY k HAVING count(*) >= {least}),
p AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM s x JOIN s y ON x.v = y.v AND x.k < y.k GROUP BY ALL),
c AS (SELECT a, b, shared, shared / CAST(za.n + zb.n - shared AS DOUBLE) AS similarity FROM p JOIN z za ON za.k = a JOIN z zb ON zb.k = b WHERE shared / CAST(za.n + zb.n - shared AS DOUBLE) >= {t}),
r AS (SELECT z.k, n, coalesce(min(c.a), z.k) AS representative FROM z LEFT JOIN c ON c.b = z.k AND c.similarity = 1 GROUP BY z.k, n)"""
_CLONES = " SELECT least(ra.representative, rb.representative) AS a, greatest(ra.representative, rb.representative) AS b, min(shared) AS shared, min(similarity) AS similarity, count(*) AS pairs FROM c JOIN r ra ON ra.k = c.a JOIN r rb ON rb.k = c.b GROUP BY 1, 2"


def _clones(spark, sf, threshold, least):
    items = documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return T.similar_sets(items, "doc_id", "line", threshold, least)


_PAIRS = " SELECT a, b, shared, similarity FROM c"


@catalog.add("WITH " + _SETS.format(least=5, t=0.7) + _PAIRS)
def jaccard_line_clones(spark, sf):
    """Every pair of documents."""
    return T.all_pairs(*_clones(spark, sf, 0.70, 5), "doc_id")


@catalog.add("WITH " + _SETS.format(least=8, t=0.85) + _PAIRS)
def jaccard_import_like(spark, sf):
    return T.all_pairs(*_clones(spark, sf, 0.85, 8), "doc_id")


@catalog.add("WITH " + _SETS.format(least=5, t=0.7) + _CLONES)
def line_clone_classes(spark, sf):
    """Pairs of representatives, and how many pairs of documents each stands for."""
    return T.clone_pairs(*_clones(spark, sf, 0.70, 5), "doc_id")


@catalog.add("WITH " + _SETS.format(least=8, t=0.85) + _CLONES)
def import_clone_classes(spark, sf):
    return T.clone_pairs(*_clones(spark, sf, 0.85, 8), "doc_id")


@catalog.add("WITH " + _SETS.format(least=5, t=0.7) + " SELECT k AS doc_id, representative, n FROM r")
def clone_members(spark, sf):
    """Which documents each representative stands for: those with the same lines."""
    return _clones(spark, sf, 0.70, 5)[1]


@catalog.add("SELECT md5(line) AS signature, count(*) AS classes FROM (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line HAVING count(*) >= 3")
def shared_signature_3plus(spark, sf):
    items = documents(spark, sf).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).distinct()
    return items.groupBy("line").agg(F.count("*").alias("classes")).where("classes >= 3").select(F.md5("line").alias("signature"), "classes")


_COS = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"


def _query_vector(spark, sf):
    return table(spark, sf, "embeddings").where("vec_id = 0").select("embedding")


@catalog.add(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, vec_id LIMIT 5")
def vector_topk_cosine(spark, sf):
    return R.cosine_top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 5).select("vec_id", F.round("score", 6).alias("score"))


@catalog.add(f"SELECT label, vec_id FROM (SELECT e.label, e.vec_id, row_number() OVER (PARTITION BY e.label ORDER BY {_COS} DESC, e.vec_id) AS k FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE k <= 3")
def vector_topk_per_label(spark, sf):
    """Metadata-filtered search, for every label at once."""
    one = F.broadcast(_query_vector(spark, sf).select(F.col("embedding").alias("q")))
    scored = table(spark, sf, "embeddings").crossJoin(one).withColumn("score", R.dot("embedding", "q") / (R.norm("embedding") * R.norm("q")))
    return top_per_group(scored, ["label"], [F.desc("score"), F.col("vec_id")], 3).select("label", "vec_id")


def vector_index(spark, sf):
    """The index of the embeddings, made once for the same files."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return vectors.opened(rows, kept_folder(spark, f"vectors-{vectors.FORMAT}-{fingerprint(rows)}"))


def _asked(spark, sf):
    """Every vector whose id is divisible by 50."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@catalog.add(f"SELECT query, rank, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query, e.vec_id, {_COS} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, e.vec_id) AS INT) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10")
def vector_index_exact(spark, sf):
    """The ten nearest of each query, from every cell of the index."""
    return vector_index(spark, sf).search(_asked(spark, sf), 10).select("query", "rank", "vec_id", F.round("score", 6).alias("score"))


@catalog.add("SELECT count(*) AS queries, 10 AS k, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def vector_index_recall(spark, sf):
    """Whether the probes that the index keeps find nine of ten true neighbours."""
    return vector_index(spark, sf).recall(_asked(spark, sf), 10).select("queries", "k", (F.col("recall") >= 0.9).alias("reached"))


@catalog.add(f"SELECT rank, vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, {_COS} AS score, CAST(row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS INT) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q WHERE e.label = q.label) WHERE rank <= 5")
def vector_index_in_label(spark, sf):
    """The nearest of one label, the label filtered before rows are scored; all cells."""
    one = table(spark, sf, "embeddings").where("vec_id = 0").first()
    index = vector_index(spark, sf)
    return index.near(list(one.embedding), 5, index.facts["cells"], F.col("label") == one.label).select("rank", "vec_id", F.round("score", 6).alias("score"))


def _mmr_sql(k: int, fetch: int, balance: float) -> str:
    """Greedy choice in k steps: each takes the best of those that are left, less its likeness to those that were taken."""
    unit = "list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))"
    out = f"WITH c AS (SELECT e.vec_id AS id, {_COS} AS score, {unit.replace('embedding', 'e.embedding')} AS u FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, e.vec_id LIMIT {fetch}), g0 AS (SELECT id, 0 AS rank FROM c WHERE false)"
    for i in range(1, k + 1):
        near = f"coalesce((SELECT max(list_dot_product(c.u, d.u)) FROM c d WHERE d.id IN (SELECT id FROM g{i - 1})), 0)"
        out += f", g{i} AS MATERIALIZED (SELECT id, rank FROM g{i - 1} UNION ALL (SELECT id, {i} FROM c WHERE id NOT IN (SELECT id FROM g{i - 1}) ORDER BY round({balance} * score - {1 - balance} * {near}, 12) DESC, id LIMIT 1))"
    return out + f" SELECT rank, id AS vec_id FROM g{k}"


@catalog.add(_mmr_sql(8, 40, 0.6))
def mmr_top8(spark, sf):
    near = R.cosine_top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 40)
    return spark.createDataFrame(R.mmr(near, 8, 0.6), "rank int, vec_id long")


BM25_QUERY = "the reading onner de token"

_BM25 = """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS x FROM w), n AS (SELECT count(*) AS n, avg(len(ws)) AS al FROM w),
f AS (SELECT doc_id, x, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT x, count(*) AS df FROM f GROUP BY x),
i AS (SELECT x, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM d, n), m AS (SELECT avg(idf) AS mean FROM i),
b AS (SELECT f.doc_id, sum(CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / al))) AS score
  FROM f JOIN i ON i.x = f.x JOIN w ON w.doc_id = f.doc_id, n, m WHERE f.x IN ('the', 'reading', 'onner', 'de', 'token') GROUP BY f.doc_id)"""


def keyword_index(spark, sf):
    """The index of the documents, made once for the same files."""
    docs = documents(spark, sf).select("doc_id", "text")
    return keyword.opened(docs, kept_folder(spark, f"words-{keyword.FORMAT}-{fingerprint(docs)}"))


@catalog.add(_BM25 + " SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 8")
def bm25_top8(spark, sf):
    return keyword_index(spark, sf).top_k(BM25_QUERY, 8).select("doc_id", F.round("score", 6).alias("score"))


@catalog.add("SELECT w AS word, count(*) AS df, sum(tf) AS occurrences FROM (SELECT doc_id, x AS w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS x FROM documents) GROUP BY ALL) GROUP BY w")
def bm25_index_words(spark, sf):
    """The whole index, summed up by word."""
    rows = keyword_index(spark, sf).blocks().select("word", F.inline("postings"))
    return rows.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@catalog.add(_BM25 + f""", kw AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM b ORDER BY score DESC, doc_id LIMIT 8),
v AS (SELECT e.vec_id AS id, row_number() OVER (ORDER BY {_COS} DESC, e.vec_id) AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY rank LIMIT 8)
SELECT id, round(sum(p), 6) AS score FROM (SELECT id, 0.4 / (60 + rank) AS p FROM kw UNION ALL SELECT id, 0.6 / (60 + rank) FROM v) GROUP BY id""")
def rrf_hybrid(spark, sf):
    words = R.ranked(keyword_index(spark, sf).top_k(BM25_QUERY, 8), "doc_id").withColumnRenamed("doc_id", "id")
    dense = R.ranked(R.cosine_top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 8), "vec_id").withColumnRenamed("vec_id", "id")
    return R.reciprocal_rank_fusion([(words, 0.4), (dense, 0.6)], "id").select("id", F.round("score", 6).alias("score"))


@catalog.add("SELECT doc_id, '[' || row_number() OVER (ORDER BY doc_id) || '] ' || source || ': ' || text[1:200] AS snippet FROM documents WHERE lower(source) LIKE '%src7%'")
def retrieval_context_format(spark, sf):
    hit = numbered(R.class_filter(documents(spark, sf).select("doc_id", "source", "text"), "SRC7", "source"), [F.col("doc_id")])
    return hit.select("doc_id", F.concat(F.lit("["), "place", F.lit("] "), "source", F.lit(": "), F.substring("text", 1, 200)).alias("snippet"))
