"""The pipeline's stages, each held against brute force on its own input."""

import collections
import random

import pytest

import corpus_pipeline as pipeline

STOP = ["the", "and", "of", "to", "is", "with"]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(STOP) if r.random() < 0.3 else "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    base, passage, leak = prose(150, 1), prose(60, 2), prose(14, 3)
    texts = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(base[:70] + ["other"] + base[71:])), (4, " ".join(prose(90, 4) + passage + prose(90, 5))), (5, " ".join(prose(90, 6)) + "\n" + " ".join(passage + prose(90, 7))),
        (6, " ".join(prose(100, 8) + leak + prose(100, 9))), (7, "SPAM!! WORDS!! " * 60), (8, "short text"), (9, None), (10, " ".join(f"{w}###" for w in prose(60, 10))),
        (11, " ".join(prose(400, 11))), (12, " ".join(prose(300, 12))), (11, " ".join(prose(400, 11))), (None, " ".join(prose(80, 13))),
    ]
    rows = [(i, t, "en", f"s{k % 3}", len(t or ""), "x") for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    ids = lambda df: collections.Counter(r.doc_id for r in df.collect())
    stages = dict(pipeline.STAGES)

    docs = pipeline.stash(stages["quality"](spark, docs, folder), "t")
    assert docs.columns == columns and ids(docs) == collections.Counter([1, 2, 3, 4, 5, 6, 11, 11, 12, None])

    docs = pipeline.stash(stages["near_duplicates"](spark, docs, folder), "t")
    assert docs.columns == columns and ids(docs) == collections.Counter([1, 4, 5, 6, 11, 12, None])

    before = {r.doc_id: r.text for r in docs.collect()}
    docs = pipeline.stash(stages["repeated_passages"](spark, docs, folder), "t")
    after = {r.doc_id: r for r in docs.collect()}
    assert docs.columns == columns and set(after) == set(before)
    passage = " ".join(prose(60, 2))
    for i, row in after.items():
        if i in (4, 5):
            assert passage not in row.text and row.n_chars == len(row.text) and len(row.text.split()) == 180
        else:
            assert row.text == before[i]

    docs = pipeline.stash(stages["benchmark_leaks"](spark, docs, folder), "t")
    assert docs.columns == columns and ids(docs) == collections.Counter([1, 4, 5, 11, 12, None])

    mixed = stages["mix"](spark, docs, folder).collect()
    assert len(mixed) == 6 and all(0 <= r.taken <= 2 * r["size"] for r in mixed)


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() == 6
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
