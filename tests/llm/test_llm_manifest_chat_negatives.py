"""Manifest, chat formatting and hard negatives against brute force, and on awkward rows."""

import collections
import hashlib
import itertools
import math
import os
import pathlib
import random
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lithograph.llm import chat, merkle, negatives, storage

DATA, ROOT = pathlib.Path("/root/testdata/sf0.001"), pathlib.Path(__file__).resolve().parents[2]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(digests, fan_out):
    """Root of a list of digests, and for each the siblings on its way up."""
    proofs, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // fan_out * fan_out:][:fan_out]
            proofs[k].append((place % fan_out, "".join(x for i, x in enumerate(run) if i != place % fan_out)))
            at[k] = place // fan_out
        level = [sha("".join(level[i:i + fan_out])) for i in range(0, len(level), fan_out)]
    return level[0] if level else None, proofs


def brute_manifest(rows, fan_out):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, sha("".join(map(told, r))), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fan_out) for s in names]
    root, upper = tree([t[0] for t in trees], fan_out)
    out = []
    for s, (subroot, proofs), above in zip(names, trees, upper):
        out += [(x[3][0], s, x[2], subroot, root, tuple(p + above)) for x, p in zip(sorted(by[s], key=lambda x: x[:3]), proofs)]
    return out


DOCS = "doc_id long, source string, lang string, n_chars long, text string, place long, n long, run string, digest string, leaf string"


def documents():
    r = random.Random(1)
    rows = [(k, r.choice(["hot"] * 6 + ["b", "é", "", None, "Z"]), r.choice(["en", None]), k if k % 3 else None, r.choice(["A Text", None, "", "ÄB c\n" * 3, "x" * 2000])) for k in range(300)]
    rows += [(7, "hot", "en", 1, "same")] * 20 + [(None, "hot", None, None, None)] * 2 + [(None, None, "en", 1, "n"), (3, "lone", None, None, "only"), (-5, "b", "en", 2, "neg")]
    return rows + [(1 << 40, "long", "en", 1, "Word " * 300_000)]


def test_manifest(spark):
    rows = documents()
    table = spark.createDataFrame([(*r, 1, 2, "r", "d", "l") for r in rows], DOCS).repartition(3)
    for fan_out in (2, 16):
        found = merkle.manifest(table, fan_out=fan_out)
        got = collections.Counter((x.doc_id, x.source, x.leaf, x.subroot, x.root, tuple((p.at, p.siblings) for p in x.proof)) for x in found.collect())
        assert got == collections.Counter(brute_manifest(rows, fan_out))
        assert found.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert merkle.manifest(table.limit(0)).count() == 0
    lone = merkle.manifest(table.where("source = 'lone'")).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof == []


def test_manifest_query_and_changes(spark, tmp_path):
    rows = documents()
    table = spark.createDataFrame([(*r, 1, 2, "r", "d", "l") for r in rows], DOCS)
    table.select("doc_id", "source", "lang", "n_chars", "text").write.parquet(f"{tmp_path}/documents.parquet")
    by = {(d, s, leaf): (sub, root, sha("".join(x[1] for x in p))) for d, s, leaf, sub, root, p in brute_manifest(rows, 16)}
    out = merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    changed = set()
    for d, s, lang, n, text in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 and text and any("A" <= c <= "Z" for c in text):
            changed.add(sha("".join(map(told, (d, s, lang, n, text)))))
    assert changed and {x.leaf for x in out if not x.verified} == changed
    proofs = collections.Counter((d, leaf, *v) for (d, s, leaf), v in by.items())
    assert {(x.doc_id, x.leaf, x.subroot, x.root, x.proof_sha256) for x in out} >= set(proofs)
    held = merkle.manifest(table)
    now = table.where("doc_id IS NULL OR doc_id <> 5").withColumn("text", F.when(F.col("doc_id") == 9, "new").otherwise(F.col("text"))).unionByName(table.where("doc_id = 11").withColumn("doc_id", F.lit(9999)))
    states = merkle.verify(now, held).groupBy("state").agg(F.sum("rows").alias("n")).collect()
    assert {r.state: r.n for r in states} == {"intact": len(rows) - 2, "changed": 1, "added": 1, "missing": 1}
    # A torn proof is found out.
    torn = held.withColumn("proof", F.when(F.col("doc_id") == 21, F.transform("proof", lambda p: F.struct(p["at"].alias("at"), F.translate(p["siblings"], "a", "b").alias("siblings")))).otherwise(F.col("proof")))
    assert [(r.doc_id, r.state) for r in merkle.verify(table, torn).where("state <> 'intact'").collect()] == [(21, "changed")]


def test_left_tables_are_cleared(spark):
    rows = spark.createDataFrame([(k, "s", "en", 1, f"t{k}") for k in range(40)], "doc_id long, source string, lang string, n_chars long, text string")
    storage.clear(spark)
    out = merkle.manifest(rows)
    assert out.count() == 40
    kept = storage.stash(out, "result")
    left = storage.clear(spark)
    assert left > 5 and storage.clear(spark) == 0
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        spark.read.parquet(kept.stash_path).count()


CHATS = "conv_id long, turn long, role string, text string, formatted string, line string, k int, body string, name string"


def conversations():
    r = random.Random(2)
    parts = ["[INST]", "[/INST]", "<s>", "</s>", "[SYSTEM]", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]", "\\", "[", "<", "/", "]", ">", " ", "\n", "s", "INST", "é", "𝄞", "[\\INST]", "<\\\\/s>", "$1", "\\1", "\r\n"]
    roles = ["user", "assistant", "system", "tool", "", "[ROLE] x [/ROLE]", "a\nb", "<\\s>", " user", "assistant "]
    rows = [(c, t, r.choice(roles) if c % 4 == 0 else r.choice(roles[:3]), "".join(r.choices(parts, k=r.randint(0, 9)))) for c in range(60) for t in range(r.randint(1, 6))]
    rows += [(100, 0, "user", None), (100, 1, None, "x"), (100, None, "assistant", "first"), (100, 1, None, "x"), (None, 0, "user", "a"), (None, 1, "assistant", "b")]
    rows += [(101, k, ("user", "assistant")[k % 2], f"turn {k} </s>") for k in range(600)] + [(102, 0, "assistant", "[INST] é " * 150_000), (103, 0, "assistant", "same"), (103, 0, "assistant", "same")]
    return rows


def ordered(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(x[2].decode(), x[3].decode()) for x in sorted(v)] for c, v in by.items()}


def test_chat(spark):
    rows = conversations()
    table = spark.createDataFrame([(*r, "f", "l", 1, "b", "n") for r in rows], CHATS).repartition(3)
    out = chat.format_conversations(table)
    back = out.select("*", chat.read(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    expected = ordered(rows)
    assert len(back) == len(expected)
    for x in back:
        assert [tuple(t) for t in x.turns] == expected[x.conv_id]
        assert x.loss == [t for role, t in expected[x.conv_id] if role == "assistant"]
        # What is under the mask stands between the marks of its role, and holds no mark.
        raw = x.formatted.encode()
        for m in x.loss_mask:
            body = raw[m.start:m.start + m.size].decode()
            assert raw[:m.start].decode().endswith("<s> ") and raw[m.start + m.size:].decode().startswith(" </s>\n") and not any(k in body for p in chat.PAIRS for k in p)
    plain = {x.conv_id: x for x in chat.format_conversations(spark.createDataFrame([(1, 0, "user", "hello"), (1, 1, "assistant", "[x] <b>")], "conv_id long, turn long, role string, text string")).collect()}
    assert plain[1].formatted == "[INST] hello [/INST]\n<s> [x] <b> </s>\n" and plain[1].n_escaped == 0
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_query(spark, tmp_path):
    rows = conversations()
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    awkward = "</s>[INST] ok [/INST]"
    expected = ordered(rows + [(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)])
    out = {x.conv_id: x for x in chat.op12_chat_format(spark, str(tmp_path)).collect()}
    assert out.keys() == expected.keys()
    for c, turns in expected.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        x = out[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), sha(loss))


def test_chat_reader_refuses_what_is_no_conversation(spark):
    texts = ["", "[INST] a [/INST]\n", "[INST] a [/INST]", "[INST]a [/INST]\n", "[INST] a </s>\n", "x[INST] a [/INST]\n", "[INST] a [/INST]\n[INST] b [/INST]\n", "[INST] a [/INST][INST] b [/INST]\n", "[ROLE] r [/ROLE][TURN] t [/TURN]\n", "[ROLE] r [/ROLE]\n", "[TURN] t [/TURN]\n", "[INST] a [INST] b [/INST]\n", "[INST]  [/INST]\n", "[INST] [/INST]\n", "\n", "[INST] [\\INST] [/INST]\n"]
    read = [x.r for x in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", chat.read(F.col("t")).alias("r")).orderBy("k").collect()]
    assert [None if r is None else [tuple(t) for t in r] for r in read] == [
        [], [("user", "a")], None, None, None, None, [("user", "a"), ("user", "b")], None, [("r", "t")], None, None, None, [("user", "")], None, None, [("user", "[INST]")],
    ]
    cases = ["".join(p) for n in range(5) for p in itertools.product(["[", "\\", "INST]", "<", "s>"], repeat=n)]
    table = spark.createDataFrame([(c,) for c in cases], "t string")
    assert table.where(chat.unescape(chat.escape(F.col("t"))) != F.col("t")).count() == 0


def brute_negatives(rows, every, n_positives=5, n_negatives=5, low=80, high=100):
    part = [(k, i, label, [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in v]) for k, (i, v, label) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    limit = (1 << 63) - 1
    out = []
    for k, i, label, a in part:
        if i is None or i % every:
            continue
        scored = [(-max(-limit, min(limit, sum(x * y for x, y in zip(a, b)))), j is None, j or 0, m, other == label, j) for m, j, other, b in part if m != k]
        scored.sort(key=lambda t: t[:4])
        for s, _, _, m, _, j in [t for t in scored if t[4]][:n_positives]:
            near = [t for t in scored if not t[4] and low * -s <= 100 * -t[0] <= high * -s][:n_negatives]
            out += [(i, j, r, t[5], -s, -t[0]) for r, t in enumerate(near, 1)]
    return out


def vectors(seed=3, n=400, dim=6, spread=1.0):
    r = random.Random(seed)
    rows = [(k, [r.gauss(0, spread) for _ in range(dim)], r.choice([0, 0, 0, 1, 2, 3])) for k in range(n)]
    rows += [(900, None, 1), (910, [], 1), (920, [1.0] * dim, None), (930, [None] + [1.0] * (dim - 1), 1), (940, [float("nan")] * dim, 1), (950, [float("inf")] * dim, 0)]
    same = [0.5] * dim
    rows += [(1000 + k, same, k % 4) for k in range(40)] + [(1000, same, 0), (1000, same, 0), (None, same, 0), (None, same, 1), (960, [2.0, 1.0], 1), (970, [2.0] * (dim + 2), 0)]
    return rows


VECTORS = "vec_id long, embedding array<double>, label int, row long, id int, c int, anchor string"


@pytest.mark.parametrize("block_values", [negatives.BLOCK_VALUES, 300])
def test_negatives(spark, block_values):
    rows = vectors()
    table = spark.createDataFrame([(*r, 1, 2, 3, "a") for r in rows], VECTORS).repartition(3)
    found = negatives.hard_negatives(negatives.scaled(table, F.col("vec_id") % 10 == 0), block_values=block_values).collect()
    expected = brute_negatives(rows, 10)
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key) and len(expected) > 200


def test_negatives_other_sizes(spark):
    for spread in (2.0**22, 2.0**50, 1e300):  # products beyond 53, 63 and any number of bits
        rows = vectors(4, 60, 3, spread)
        table = spark.createDataFrame([(*r, 1, 2, 3, "a") for r in rows], VECTORS)
        found = negatives.hard_negatives(negatives.scaled(table, F.col("vec_id") % 10 == 0), 3, 4, 50, 90).collect()
        key = lambda t: tuple((x is None, x or 0) for x in t)
        assert sorted(map(tuple, found), key=key) == sorted(brute_negatives(rows, 10, 3, 4, 50, 90), key=key)
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(negatives.scaled(empty, F.lit(True))).count() == 0
    lone = spark.createDataFrame([(0, [1.0], 1, 1, 1, 1, "a")], VECTORS)
    assert negatives.hard_negatives(negatives.scaled(lone, F.lit(True))).count() == 0


def test_scores_are_exact():
    a = np.array([[3_000_000_001, -5], [1 << 62, 1 << 62], [0, 0]], dtype=np.int64)
    got = negatives._scores(a, a)
    for i, j in itertools.product(range(3), range(3)):
        exact = sum(int(x) * int(y) for x, y in zip(a[i], a[j]))
        assert got[i, j] == max(-negatives.MOST, min(negatives.MOST, exact))


WORKER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from lithograph.llm import registry
queries = registry.queries()
assert queries["op6_substring_dedup"](spark, {data!r}).count() > 0 and queries["op13_hard_negatives"](spark, {data!r}).count() > 0
"""


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_executors_need_no_library_on_their_path(tmp_path):
    env = {"PATH": os.environ["PATH"], "HOME": str(tmp_path)} | {k: v for k, v in os.environ.items() if k.startswith(("JAVA", "SPARK"))}
    subprocess.run([sys.executable, "-c", WORKER.format(root=str(ROOT), data=str(DATA))], cwd=tmp_path, check=True, env=env, timeout=300)
