"""N-gram Jaccard join: T-occurrence search with DivideSkip over inverted lists.

Documents are sets of word shingles; two link when their Jaccard similarity reaches
``percent`` / 100.  The result is each document's component of links and its number of
links.

1.  The document frequency of every shingle is counted (``chunks``) and comes back as a
    power of two.  A document that shares fewer shingles than a partner would need is
    finished: this is exact and ends the search for all documents without near copies.
2.  The rest are ordered by rarity.  A pair that links must share one of the first
    n - T + 1 shingles of either (T: the least overlap with any partner), so documents
    that share such a shingle form clusters (components over star edges, never pairs).
3.  Within a cluster, DivideSkip: a document's inverted lists are split into the L
    longest and the rest; the short runs are merged (a merge of sorted runs), documents
    that occur at least T - L times are probed in the long lists by binary search, and
    those that reach the overlap of the pair link.  Every candidate is verified; links
    are added up by document, weighted by the rows of the partner, and only those that
    first connect two components of a task are written.  Clusters of over
    ``BLOCK_SHINGLES`` are dealt as pairs of blocks, so that no task holds more than two
    blocks; each pair of documents meets in one task.
4.  Components of the links that were written.

Defined results
    * null or blank text: n_shingles 0, linked with nothing;
    * 1 to 4 words: one shingle, the whole sequence;
    * n_links counts the other rows with which a row links, those of equal text among them;
    * equal texts and repeated rows are linked; rows with a null id count as documents
      whose id is never the smallest (component_id is null if no id is known);
    * extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm import chunks as C
from lithograph.llm.components import components
from lithograph.llm.storage import stash

#: Shingles of a block of documents that one task indexes.
BLOCK_SHINGLES = 1 << 20

SETS_SCHEMA = "sha binary, node binary, set_key binary, min_id long, copies long, n_shingles long, prefix array<long>, shingles binary, size long"


def shingle_sets(texts: list[bytes], words_per: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and where each text's begin."""
    words, ends = C.word_hashes(texts, True)
    at, text = C.window_starts(ends, words_per)
    hashes = C.rolling(words, words_per)[at] if len(at) else np.empty(0, np.uint64)
    counts = np.diff(ends)
    for n in range(1, words_per):
        if len(few := np.flatnonzero(counts == n)):
            hashes = np.concatenate([hashes, C.rolling(words, n, 7)[ends[few]]])
            text = np.concatenate([text, few])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    hashes, text = hashes[fresh], text[fresh]
    return hashes, np.searchsorted(text, np.arange(len(texts) + 1))


def least_overlap(n, percent: int):
    """The fewest shared shingles with which a set of n links to any other."""
    return -(-percent * n // 100)


class Links:
    """Union-find over the documents of a task."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def roots(self, many: np.ndarray) -> np.ndarray:
        out = self.up[many]
        while True:
            above = self.up[out]
            if (above == out).all():
                return out
            out = above

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def divide_skip(sizes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int, rows: np.ndarray | None = None, n_links: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all documents which are linked through this block (or pair of blocks).

    Every link is verified; ``n_links`` (if given) grows by the ``rows`` of each partner.

    ``sets`` hold the shingles that other documents share as well; ``sizes`` count all.
    side: 0 and 1 for two blocks, of which only pairs across are wanted; all 0 for one.
    """
    n = len(sets)
    across = bool(side.any())
    lengths = np.array([len(s) for s in sets], np.int64)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), lengths)
    lists, place = np.unique(tokens, return_inverse=True)
    indexed = side[owner] == 0
    order = np.argsort(place[indexed], kind="stable")
    posting = owner[indexed][order]  # by list, then by document
    bounds = np.searchsorted(place[indexed][order], np.arange(len(lists) + 1))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    found: list[tuple[int, int]] = []
    links = Links(n)
    for q in range(n):
        if across and side[q] == 0:
            continue
        mine = place[starts[q] : starts[q + 1]]
        lo, hi = bounds[mine], bounds[mine + 1]
        if not across:  # each pair once: documents before q
            hi = np.array([a + np.searchsorted(posting[a:b], q) for a, b in zip(lo.tolist(), hi.tolist())], np.int64)
        least = least_overlap(int(sizes[q]), percent)
        used = hi > lo
        lo, hi = lo[used], hi[used]
        if len(lo) < least:
            continue
        by_length = np.argsort(hi - lo, kind="stable")
        longest = int(hi[by_length[-1]] - lo[by_length[-1]])
        skipped = min(least - 1, int(least / (0.0085 * math.log2(longest + 1) + 1)))
        short, long = by_length[: len(lo) - skipped], by_length[len(lo) - skipped :]
        runs = np.concatenate([posting[lo[k] : hi[k]] for k in short])
        runs.sort(kind="stable")  # merges the sorted runs
        edge = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
        candidates, seen = runs[edge[:-1]], np.diff(edge)
        keep = seen >= least - skipped
        candidates, seen = candidates[keep], seen[keep]
        if not len(candidates):
            continue
        for k in long:
            run = posting[lo[k] : hi[k]]
            spot = np.searchsorted(run, candidates)
            seen += (spot < len(run)) & (run[np.minimum(spot, len(run) - 1)] == candidates)
        linked = candidates[100 * seen >= percent * (sizes[q] + sizes[candidates] - seen)]
        if n_links is not None:
            n_links[linked] += rows[q]
            n_links[q] += rows[linked].sum()
        for c in linked[links.roots(linked) != links.root(q)].tolist():
            if links.root(c) != links.root(q):
                links.join(c, q)
                found.append((c, q))
    return found


def _sets(docs: DataFrame, words_per: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    total = C.corpus_bytes(docs, text_col)
    texts = C.distinct_texts(docs, total, id_col, text_col)
    keys = C.Keys(total // 5 + 1, growth=C.growth(total))

    @C.released
    def ask(table: pa.Table) -> pa.Table:
        chunk = C.Chunk(table)
        hashes, _ = shingle_sets(chunk.texts, words_per)
        distinct, counts = np.unique(keys.cut(hashes), return_counts=True)
        return C.request_table(keys.requests(chunk.number, distinct, counts.astype(np.uint32)))

    @C.released
    def select(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            chunk = C.Chunk(table)
            hashes, starts = shingle_sets(chunk.texts, words_per)
            _, back = np.unique(keys.cut(hashes), return_inverse=True)
            classes = C.join_answers(answers, np.uint8)[back] if len(back) else np.empty(0, np.uint8)
            shared = np.concatenate([[0], np.cumsum(classes > 0)])
            shared = shared[starts[1:]] - shared[starts[:-1]]
            for i, sha in enumerate(chunk.shas):
                n = int(starts[i + 1] - starts[i])
                row = (sha, sha[:16], sha[:16], chunk.ids[i], int(chunk.copies[i]), n)
                if n == 0 or shared[i] < (least := least_overlap(n, percent)):
                    rows.append((*row, None, None, 0))
                    continue
                mine, rare = hashes[starts[i] : starts[i + 1]], classes[starts[i] : starts[i + 1]]
                order = np.argsort(rare, kind="stable")  # by class, then by hash
                held = mine[order][rare[order] > 0]
                prefix = held[: max(0, n - least + 1 - (n - len(held)))]
                if len(held) == n:
                    row = (sha, sha[:16], hashlib.blake2b(mine.tobytes(), digest_size=16).digest(), chunk.ids[i], int(chunk.copies[i]), n)
                rows.append((*row, prefix.view(np.int64).tolist(), held.tobytes(), len(held)))
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64())
        names = ("sha", "node", "set_key", "min_id", "copies", "n_shingles", "prefix", "shingles", "size")
        cols = list(zip(*rows)) if rows else [[]] * 9
        return pa.table({k: pa.array(v, t) for k, v, t in zip(names, cols, kinds)})

    asked = texts.groupBy("chunk").applyInArrow(ask, C.REQUEST_SCHEMA)
    classes = C.answer_requests(asked, keys, C.log_class)
    return texts.groupBy("chunk").cogroup(classes.groupBy("chunk")).applyInArrow(select, SETS_SCHEMA)


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, n): edges between nodes that link, enough of them to connect every component; and
    rows with a null v that add n to the links of each row of the set whose first node is u."""
    some = sets.where(F.col("shingles").isNotNull())
    first = some.groupBy("set_key").agg(F.min("node").alias("node"), F.sum("copies").alias("copies"))
    same = some.select("node", "set_key").join(first.select("set_key", F.col("node").alias("hub")), "set_key").where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v"), F.lit(0).cast("long").alias("n"))
    unique = some.drop("copies").join(first.select("node", "copies"), "node")

    rare = unique.select("node", F.explode("prefix").alias("shingle"))
    hubs = rare.groupBy("shingle").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    star = rare.join(hubs, "shingle").where("node != hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    clusters = components(star)

    members = stash(unique.select("node", "copies", "n_shingles", "shingles", "size").join(clusters, "node"), "clusters")
    sizes = members.groupBy("label").agg(F.sum("size").alias("total"))
    sizes = sizes.withColumn("blocks", F.ceil(F.col("total") / BLOCK_SHINGLES))
    small = sizes.where("blocks = 1").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    batches = max(1, math.ceil(small / BLOCK_SHINGLES))
    members = members.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    # A cluster of k blocks becomes k (k + 1) / 2 tasks; block i goes to the pairs that hold it.
    dealt = members.select(
        "node", "copies", "n_shingles", "shingles", "block",
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(batches)).cast("string")).otherwise(F.hex("label")).alias("task"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with_block"),
    ).select("node", "copies", "n_shingles", "shingles", "block", "task", F.least("block", "with_block").alias("lo"), F.greatest("block", "with_block").alias("hi"))

    @C.released
    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_shingles", "ascending"), ("node", "ascending")])
        nodes = table["node"].to_pylist()
        block = np.array(table["block"].to_pylist())
        held = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        side = (block != table["lo"][0].as_py()).astype(np.int64)
        n_links = np.zeros(len(nodes), np.int64)
        found = divide_skip(np.array(table["n_shingles"].to_pylist(), np.int64), held, side, percent, table["copies"].to_numpy(), n_links)
        some = np.flatnonzero(n_links).tolist()
        u, v = [nodes[a] for a, _ in found] + [nodes[i] for i in some], [nodes[b] for _, b in found] + [None] * len(some)
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "n": pa.array([0] * len(found) + n_links[some].tolist(), pa.int64())})

    return dealt.groupBy("task", "lo", "hi").applyInArrow(search, "u binary, v binary, n long").unionByName(same)


def jaccard_components(docs: DataFrame, words_per: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct text (``sha``): n_shingles, min_id (of its rows), component_id, n_links of each of its rows, and whether it is its component's first."""
    sets = stash(_sets(docs, words_per, percent, id_col, text_col), "sets")
    links = stash(_links(sets, percent), "links")
    labels = components(links.where("v IS NOT NULL").select("u", "v"))
    # Equal sets have equal links: those of the first node, and every row of the set.
    near = links.where("v IS NULL").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    firsts = sets.groupBy("set_key").agg(F.min("node").alias("node"), F.sum("copies").alias("rows"))
    counted = firsts.join(near, "node", "left").select("set_key", (F.coalesce("n", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    named = sets.select("sha", "node", "set_key", "n_shingles", "min_id").join(counted, "set_key").withColumn("n_links", F.when(F.col("n_shingles") > 0, F.col("n_links")).otherwise(0))
    named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # The smallest known id of a component, and the text that holds it (by its key where ids repeat).
    first = F.struct(F.col("min_id").isNull().alias("unknown"), "min_id", "sha")
    least = named.groupBy("label").agg(F.min(first).alias("first")).select("label", F.col("first.min_id").alias("component_id"), F.col("first.sha").alias("_first"))
    return named.join(least, "label").select("sha", "n_shingles", "min_id", "component_id", "n_links", (F.col("sha") == F.col("_first")).alias("representative"))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return document_links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def document_links(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and n_links."""
    out = C.attach(docs, jaccard_components(docs).select("sha", "n_shingles", "component_id", "n_links"))
    # Texts without words link with nothing, not even with each other.
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "n_links")


ORACLE_SQL = {
    "op3_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT r, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.r AS u, b.r AS v FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
t(u, v) AS (SELECT r, r FROM s UNION SELECT t.u, l.v FROM t JOIN l ON t.v = l.u),
c AS (SELECT u, min(doc_id) AS component_id FROM t JOIN s ON t.v = s.r GROUP BY u),
k AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links FROM s JOIN c ON s.r = c.u LEFT JOIN k ON s.r = k.u""",
}
