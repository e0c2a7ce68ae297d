"""Keyword and vector indexes against brute force, and what their queries read."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithograph.functions import files as fs
from lithograph.operators import keyword_index, retrieval, vector_index
from lithograph.streaming.events import work_folder


def texts(n=400):
    r = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join(["common"] * r.randint(1, 3) + r.choices(words, weights=[1 / (i + 1) for i in range(60)], k=r.randint(0, 30)))) for k in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "rare rare\trare x common"), (1004, "rare " * 300)]


def brute(rows, query, k, k1=1.5, b=0.75, epsilon=0.25):
    import re

    docs = {i: [w for w in re.split(r"[ \t\n\x0b\f\r]+", t or "") if w] for i, t in rows}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = collections.Counter(w for ws in docs.values() for w in set(ws))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    average = sum(idf.values()) / len(idf)
    idf = {w: x if x >= 0 else epsilon * average for w, x in idf.items()}
    scores = {i: sum(idf[w] * ws.count(w) * (k1 + 1) / (ws.count(w) + k1 * (1 - b + b * len(ws) / mean)) for w in set(query.split()) if w in ws) for i, ws in docs.items()}
    return sorted(((i, s) for i, s in scores.items() if s), key=lambda x: (-x[1], x[0]))[:k]


def test_keyword_index(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    index = keyword_index.build(docs, work_folder(spark, "words"), cell_docs=8)
    assert index.facts["cells"] == 64 and index.facts["documents"] == len(rows)
    for query, k in (("rare w3 common", 5), ("common", 7), ("w50 w51 nowhere", 8), ("w1", 500), ("nowhere", 3), ("", 3)):
        for first in (1, 8, 100):
            found = [(r.doc_id, r.score) for r in index.top_k(query, k, first=first).collect()]
            expected = brute(rows, query, k)
            assert [i for i, _ in found] == [i for i, _ in expected] and [s for _, s in found] == pytest.approx([s for _, s in expected])
        assert [r.doc_id for r in retrieval.bm25_top_k(docs, query, k).collect()] == [i for i, _ in expected] if query else True
    # No text is read, words reach the scan, and cells that cannot hold one of the best are not scored.
    plan = index.top_k("rare w3", 3)._jdf.queryExecution().toString()
    assert "text" not in plan.replace("context", "") and "In(word, [rare,w3])" in plan
    weights = index.weights(["rare", "common"], 0.25)
    bounds = {r.cell: r.bound for r in index.bounds(weights, 1.5, 0.75).collect()}
    third = brute(rows, "rare common", 2)[-1][1]
    assert sum(x >= third for x in bounds.values()) < len(bounds) / 4
    scored = index.scores(weights, index.blocks().where(F.col("word").isin("rare", "common")), 1.5, 0.75)
    assert all(r.score <= bounds[r.cell] + 1e-9 for r in scored.withColumn("cell", F.expr("CAST(pmod(xxhash64(doc_id), 64) AS INT)")).collect())
    # It is made once.
    names = fs.names(spark, f"{index.folder}/blocks")
    assert fs.names(spark, f"{keyword_index.opened(docs.where('false'), index.folder).folder}/blocks") == names
    empty = keyword_index.build(docs.limit(0), work_folder(spark, "words"))
    assert empty.top_k("rare", 3).count() == 0


def clustered(n=3000, dim=16, groups=25):
    r = np.random.default_rng(7)
    centres = r.normal(size=(groups, dim)) * 3
    rows = centres[r.integers(0, groups, n)] + r.normal(size=(n, dim)) * 0.6
    rows[: n // 3] = rows[0]  # a vector that a third of all rows share
    return rows


def test_vector_index(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 200)
    rows = clustered()
    table = spark.createDataFrame([(k, [float(x) for x in v], k % 3) for k, v in enumerate(rows)] + [(-1, None, 0), (None, [1.0] * 16, 0)], "vec_id long, embedding array<double>, label int")
    index = vector_index.build(table, work_folder(spark, "vectors"), k=5)
    held = index.rows().select("vec_id", "cell", "block").toPandas()
    assert sorted(held["vec_id"]) == list(range(3000)) and held.groupby(["cell", "block"]).size().max() <= 300
    ask = table.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    score = unit[::50] @ unit.T
    exact = {(r.query, r.rank): (r.vec_id, r.score) for r in index.search(ask, 5).collect()}
    for k, line in enumerate(score):
        best = sorted(range(3000), key=lambda i: (-round(line[i], 12), i))[:5]
        assert [round(exact[k * 50, n + 1][1], 9) for n in range(5)] == [round(line[i], 9) for i in best]
    facts = index.facts
    told = index.recall(ask, 5).first()
    assert told.queries == 60 and told.recall >= 0.9 and facts["probes"] <= facts["cells"] / 2
    assert index.recall(ask, 5, facts["cells"]).first().recall == 1.0
    one = [float(x) for x in rows[2950]]
    near = index.near(one, 4)
    assert "PartitionFilters: [isnotnull(cell" in near._jdf.queryExecution().toString() or "PartitionFilters: [cell" in near._jdf.queryExecution().toString()
    assert near.collect()[0].vec_id == 2950
    assert {r.vec_id % 3 for r in index.near(one, 6, facts["cells"], F.col("label") == 1).collect()} == {1}
    lone = vector_index.build(table.where("vec_id = 5"), work_folder(spark, "vectors"))
    assert [r.vec_id for r in lone.search(ask.limit(1), 3).collect()] == [5]


def test_a_cell_of_the_keyword_index_is_made_by_one_task(spark):
    """Texts are shuffled once, by cell: all blocks of a cell lie in one file, sorted by word, with their numbers beside the postings."""
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    rows = keyword_index.build(docs, work_folder(spark, "words"), cell_docs=50).blocks().withColumn("file", F.input_file_name())
    assert rows.groupBy("cell").agg(F.count_distinct("file").alias("n")).where("n > 1").isEmpty()
    assert rows.where("df <> size(postings) OR occurrences <> aggregate(postings, 0L, (s, p) -> s + p.tf)").isEmpty()
