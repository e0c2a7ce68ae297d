"""Substring deduplication: Rabin-Karp hashes of every fixed-length word window.

Every window of ``window`` consecutive words of every text is hashed and counted over
the corpus.  Windows that occur more than once cover the words to remove; overlapping
ones merge into maximal intervals.  Counting takes two rounds: a hash of about 45 bits
finds candidate windows, and the candidates are counted again by 96 bits of two Rabin-Karp
hashes over independent hashes of the words' bytes, which decides: among the 2e13 windows
of 100 TB, any two different ones are taken for equal with a probability of about 0.003.

Defined results
    * null text: no words; a text shorter than the window loses nothing;
    * repeated rows and equal texts: each is another place, so all copies lose every
      word that a window covers;
    * duplicate ids, null ids and extra columns: rows stay rows, nothing is merged;
    * an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.llm import chunks as C

TEXTS_SCHEMA = "sha binary, n_words long, n_removed long, starts array<long>, ends array<long>, kept string"


def _windows(chunk: C.Chunk, window: int):
    words, ends = C.word_hashes(chunk.texts, False)
    at, text = C.window_starts(ends, window)
    return ends, at, text, C.rolling(words, window)[at] if len(at) else np.empty(0, np.uint64)


def _second(texts: list[bytes], window: int, at: np.ndarray) -> np.ndarray:
    """The other half of the confirming hash: other hashes of the words, another salt."""
    return (C.rolling(C.word_hashes(texts, False, 1)[0], window, 1)[at] >> np.uint64(32)).astype(np.uint32)


def _candidates(cut: np.ndarray, text: np.ndarray, chunk: C.Chunk):
    distinct, back = np.unique(cut, return_inverse=True)
    return distinct, back, np.minimum(np.bincount(back, chunk.copies[text]), 1 << 24).astype(np.uint32)


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per distinct text (``sha``): words, the removed word intervals [start, end), and what is kept.

    Join to documents with ``chunks.attach``.
    """
    total = C.corpus_bytes(docs, text_col)
    texts = C.distinct_texts(docs, total, id_col, text_col)
    grown = C.growth(total)
    first, second = C.Keys(total // 5 + 1, growth=grown), C.Keys(total // 20 + 1, 8, grown)

    @C.released
    def ask(table: pa.Table) -> pa.Table:
        chunk = C.Chunk(table)
        *_, text, hashes = _windows(chunk, window)
        distinct, _, counts = _candidates(first.cut(hashes), text, chunk)
        return C.request_table(first.requests(chunk.number, distinct, counts))

    def pairs(chunk: C.Chunk, classes: np.ndarray):
        """Candidate windows, and their distinct 96-bit keys."""
        ends, at, text, hashes = _windows(chunk, window)
        _, back, _ = _candidates(first.cut(hashes), text, chunk)
        found = classes[back] > 0 if len(back) else np.zeros(0, bool)
        at, text, one = at[found], text[found], hashes[found]
        two = _second(chunk.texts, window, at) if len(at) else np.empty(0, np.uint32)
        order = np.lexsort((two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(one[order]) != 0) | (np.diff(two[order].astype(np.int64)) != 0)
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(fresh) - 1
        return ends, at, text, one[order][fresh], two[order][fresh], group

    @C.released
    def confirm(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return C.request_table([])
        chunk = C.Chunk(table)
        _, _, text, one, two, group = pairs(chunk, C.join_answers(answers, np.uint8))
        counts = np.minimum(np.bincount(group, chunk.copies[text]), 1 << 24).astype(np.uint32)
        return C.request_table(second.requests(chunk.number, one, counts, two))

    @C.released
    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("sha", "n_words", "n_removed", "starts", "ends", "kept")}
        chunk = C.Chunk(table) if table.num_rows else None
        if chunk:
            one, two = (answers.filter(pc.equal(answers["round"], pa.scalar(r, pa.int32()))) for r in (1, 2))
            ends, at, text, *_, group = pairs(chunk, C.join_answers(one, np.uint8))
            repeated = C.join_answers(two, np.uint8)[group] > 0 if len(group) else np.zeros(0, bool)
            cover = np.zeros(int(ends[-1]) + 1, np.int64)
            np.add.at(cover, at[repeated], 1)
            np.add.at(cover, at[repeated] + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            for i, sha in enumerate(chunk.shas):
                mask = gone[ends[i] : ends[i + 1]]
                words = chunk.texts[i].split()
                steps = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                rows["sha"].append(sha)
                rows["n_words"].append(len(words))
                rows["n_removed"].append(int(mask.sum()))
                rows["starts"].append(steps[::2].tolist())
                rows["ends"].append(steps[1::2].tolist())
                if len(steps):
                    words = [w for w, g in zip(words, mask.tolist()) if not g]
                rows["kept"].append(b" ".join(words).decode("utf-8", "replace"))
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds)})

    asked = texts.groupBy("chunk").applyInArrow(ask, C.REQUEST_SCHEMA)
    classes = C.answer_requests(asked, first, C.log_class)
    again = texts.groupBy("chunk").cogroup(classes.groupBy("chunk")).applyInArrow(confirm, C.REQUEST_SCHEMA)
    decided = C.answer_requests(again, second, C.log_class, extra=True)
    both = classes.withColumn("round", F.lit(1)).unionByName(decided.withColumn("round", F.lit(2)))
    return texts.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(cut, TEXTS_SCHEMA)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = substring_dedup(docs).select("sha", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return C.attach(docs, texts).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: SQL for rows of ``documents`` with the words of the query and the text that is kept.
KEPT_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT r, i, x, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS g FROM p),
c AS (SELECT r, i, x, len(g) = 35 AND count(*) OVER (PARTITION BY array_to_string(g, ' ')) > 1 AS again FROM q),
m AS (SELECT r, i, x, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
k AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY r)
SELECT d.* EXCLUDE (r, w), CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, coalesce(k.kept, '') AS kept_text FROM d LEFT JOIN k ON d.r = k.r"""

ORACLE_SQL = {"op6_substring_dedup": f"SELECT doc_id, n_words, n_removed, sha256(kept_text) AS kept_sha256 FROM ({KEPT_SQL})"}
