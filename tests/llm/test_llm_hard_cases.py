"""Awkward inputs: colliding words, several chunks and buckets, long texts; and references in SQL or Python."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lithograph.llm import chunks, ctw, decontaminate, jaccard, language, mixing, quality, registry, substring, suffix, urls, warc
from test_llm_operators import SCHEMA, rows, same, words


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def brute_substring(many, window=35):
    counts = collections.Counter()
    for t in many:
        w = t.split()
        counts.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    for t in many:
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        yield len(w), sum(gone), digest(" ".join(x for x, g in zip(w, gone) if not g).encode())


def brute_suffix(many, length=50):
    first = {}
    for i, t in enumerate(many):
        for k in range(len(t) - length + 1):
            first.setdefault(hash(t[k : k + length]), i)
    for i, t in enumerate(many):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[hash(t[k : k + length])] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        yield len(t), sum(gone), spans, digest(bytes(c for c, g in zip(t, gone) if not g))


def brute_jaccard(many):
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := t.lower().split()) > 4 else {tuple(w)} if w else set() for t in many]
    label, links = list(range(len(many))), [0] * len(many)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                x, y = sorted((label[i], label[j]))
                label = [x if k == y else k for k in label]
    return [(i, len(a), label[i], links[i]) for i, a in enumerate(sets)]


def brute_unigrams(many):
    split = [[*t.lower().split(), "\0end"] for t in many]
    out = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(many))]
    counts = collections.Counter(w for ws, o in zip(split, out) if not o for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, out[i], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in enumerate(split)]


def check_all(spark, many):
    """Operators 3, 6, 7 and 10 against brute force on texts numbered from 0."""
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(3).cache()
    same(jaccard.document_links(docs).select("doc_id", "n_shingles", "component_id", "n_links").collect(), brute_jaccard(many))
    found = chunks.attach(docs, substring.substring_dedup(docs)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    same(found, [(i, *x) for i, x in enumerate(brute_substring(many))])
    same(suffix._per_document(docs).collect(), [(i, *x) for i, x in enumerate(brute_suffix([t.encode() for t in many]))])
    scored = ctw.score_documents(docs).collect()
    same([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in scored], brute_unigrams(many))
    return {r.doc_id: r.score for r in scored}


def test_many_chunks_and_buckets_give_the_same_rows(spark, monkeypatch):
    r, common = random.Random(3), words(60, 40)
    near = words(70, 41)
    many = [" ".join([*words(r.randint(0, 90), 100 + k), *common, *words(r.randint(0, 40), 300 + k)]) for k in range(40)]
    many += [" ".join(near[:k] + ["x"] + near[k + 1 :]) for k in range(10, 60, 7)] + [" ".join(near)] * 3
    whole = check_all(spark, many)
    for module, name, size in ((chunks, "CHUNK_BYTES", 3000), (chunks, "BUCKET_KEYS", 256), (suffix, "CHUNK_BYTES", 2000), (suffix, "BUCKET_BYTES", 3000), (ctw, "PATH_BYTES", 2000)):
        monkeypatch.setattr(module, name, size)
    split = check_all(spark, many)
    assert all(math.isclose(split[i], whole[i], rel_tol=1e-5) for i in whole)


def test_growth_keeps_traffic_linear(monkeypatch):
    assert chunks.growth(10**11) == 1 and 15 < chunks.growth(10**14) < 17
    monkeypatch.setattr(chunks, "SCALE_BYTES", 1e9)
    assert chunks.Keys(1 << 30, growth=chunks.growth(4 * 10**9)).bits == chunks.Keys(1 << 30).bits - 1


@pytest.mark.parametrize("expected", [1, 1 << 21, 1 << 34, 1 << 42, 1 << 60])
def test_keys_pack_and_unpack(expected):
    keys = chunks.Keys(expected)
    hashes = np.unique(keys.cut(np.random.default_rng(1).integers(0, 1 << 64, 5000, np.uint64)))
    counts = np.arange(len(hashes), dtype=np.uint32)
    back, seen = [], []
    for bucket, _, n, payload in keys.requests(7, hashes, counts):
        key, count, _ = keys.unpack(n, payload, False)
        back.append(key if keys.whole else key | np.uint64(bucket << (8 * keys.width)))
        seen.append(count)
    assert (np.concatenate(back) == hashes).all() and (np.concatenate(seen) == counts).all()


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


def test_words_that_collide_as_polynomials(spark):
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    hashes, ends = chunks.word_hashes([f"{one} {two} {one}".encode(), b"abcdefgh abcdefghi abcdefghij abcdefgh", "ÄB äb".encode()], False)
    assert hashes[0] == hashes[2] != hashes[1] and len(set(hashes.tolist())) == 7 and ends.tolist() == [0, 3, 7, 9]
    assert (hashes != chunks.word_hashes([f"{one} {two} {one}".encode(), b"abcdefgh abcdefghi abcdefghij abcdefgh", "ÄB äb".encode()], False, 1)[0]).all()
    shared = words(34, 60)
    check_all(spark, [" ".join([one, *shared]), " ".join([two, *shared]), " ".join([thue_morse(1024, "c", "d"), *shared])])


def test_rolling_does_not_depend_on_slabs(monkeypatch):
    values = np.random.default_rng(2).integers(0, 1 << 64, 1000, np.uint64)
    whole = chunks.rolling(values, 35)
    monkeypatch.setattr(chunks, "SLAB", 64)
    assert (chunks.rolling(values, 35) == whole).all()
    assert (chunks.power_at(chunks.BASE, np.arange(9000)) == chunks.powers(chunks.BASE, 9000)).all()


def test_texts_of_over_a_megabyte(spark):
    long = words(260_000, 70)
    passage = words(50, 71)
    many = [" ".join(long), " ".join(long[:130_000] + ["changed"] + long[130_000:]), " ".join(words(40, 72) + passage), " ".join(passage + words(30, 73)), "x" * 1_200_000, ""]
    assert len(many[0]) > 1_300_000
    check_all(spark, many)
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(long[200_000:200_012]))], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate._per_document(docs, items).collect() if r.n_hit} == {0: 12, 1: 12}
    pages = spark.createDataFrame([(1, "http://a.com/" + "é" * 1_200_000, "<html>" + many[0]), (2, "http://a.com/", "der hund")], "page_id long, url string, html string")
    judged = urls.filter_urls(pages, urls.UrlModel([], []))
    assert judged.where("verdict = 'allow'").count() == 2
    known = spark.createDataFrame([("xx", many[0]), ("de", "der hund und die katze " * 9)], "lang string, text string")
    assert {r.page_id: r.lang for r in language.identify(pages, known).collect()} == {1: "xx", 2: "de"}


def test_language_by_brute_force(spark, monkeypatch):
    known = [("en", "the cat and the dog sat on the mat with the hat " * 3), ("de", "der hund und die katze sind auf dem dach " * 3), ("fr", "le chat et le chien sont sur le toit avec la souris " * 3)]
    pages = [
        (1, "http://www.a.de/x", '<html lang="de"><p>die katze und der hund</p></html>'), (2, "http://b.com/", "<p>the dog and the cat</p>"), (3, "http://www.a.de/z", "<p>sat</p>"), (4, "http://m.a.de/", ""),
        (5, None, None), (6, "http://c.fr/", '<html lang="fr"><p>le toit</p></html>'), (7, "http://c.fr/9", "<html lang=fr>42"), (8, "http://www.a.de/x", "der mat"), (8, "http://www.a.de/x", "der mat"),
    ]
    names = sorted(x for x, _ in known)

    def grams(text):
        raw = b" " + text.lower().encode() + b" "
        ok = lambda c: 97 <= c <= 122 or c >= 128 or c == 32
        for k in range(len(raw) - 2):
            if all(map(ok, raw[k : k + 3])):
                yield int(chunks.mix(np.array([(raw[k] << 16) | (raw[k + 1] << 8) | raw[k + 2]], np.uint64))[0]) % language.BUCKETS

    counts = {lang: collections.Counter(g for x, t in known if x == lang for g in grams(t)) for lang in names}
    size = {lang: sum(c.values()) + 0.5 * language.BUCKETS for lang, c in counts.items()}
    seen = []
    for _, url, html in pages:
        import re

        host = (url or "://").split("://")[1].split("/")[0].lower()
        text = re.sub(r"<[^>]*>", " ", html or "")
        found = list(grams(text))
        weight = min(len(found) / 3, language.TEXT_WEIGHT) / max(1, len(found))
        logs = [weight * sum(math.log((counts[x][g] + 0.5) / size[x]) for g in found) for x in names]
        p = [math.exp(x - max(logs)) for x in logs]
        tag = re.search(r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-z]{2,3})""", html or "")
        part = lambda pattern: m[1] if (m := re.search(pattern, host)) else ""  # noqa: B023, E731
        seen.append((logs, [x / sum(p) for x in p], host, part(r"([^.]+\.[^.]+)$"), tag[1].lower() if tag else "", part(r"\.([a-z]{2,})$")))
    expected = []
    for i, (logs, _, host, domain, declared, suffix_) in enumerate(seen):
        others = [s for k, s in enumerate(seen) if k != i]
        total = lambda rows: [sum(s[1][k] for s in rows) for k in range(3)]
        prior = [(s + 1) / (len(others) + 3) for s in total(others)]
        for level, value in ((3, domain), (2, host)):
            own = [s for s in others if s[level] == value]
            prior = [(s + 5 * q) / (len(own) + 5) for s, q in zip(total(own), prior)]
        out = [math.log(q) + x for q, x in zip(prior, logs)]
        for level, value in ((4, declared), (5, suffix_)):
            values = len({s[level] for s in seen})
            given = total([s for s in others if s[level] == value])
            out = [x + math.log((g + 1) / (a + values)) for x, g, a in zip(out, given, total(others))]
        best = max(out)
        expected.append((pages[i][0], names[out.index(best)], round(1 / sum(math.exp(x - best) for x in out), 4)))
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    corpus = spark.createDataFrame(known, "lang string, text string")
    found = [(r.page_id, r.lang, round(r.posterior, 4)) for r in language.identify(table, corpus).collect()]
    same(found, expected)
    by = {r.page_id: (r.text_lang, r.lang) for r in language.identify(table, corpus).collect()}
    assert by[7] == ("de", "fr") and by[1] == ("de", "de")
    monkeypatch.setattr(language, "LANGUAGE_BLOCK", 2)
    same([(r.page_id, r.lang, round(r.posterior, 4)) for r in language.identify(table, corpus).collect()], expected)


def duck(tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow() if name in ("conversations", "embeddings") else df.toPandas())
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_agree_with_their_sql(spark, tmp_path, name):
    """On rows with nulls, ties, repeated rows and clashing names."""
    docs = spark.createDataFrame([r for r in rows() if r[0] is not None and r[0] != 1 or r[0] == 1 and r[9] == 0], SCHEMA)
    if name == "op8_weighted_mix":
        docs = spark.createDataFrame(rows() + rows()[:4] * 3, SCHEMA)
    passage = words(45, 2)
    tables = {
        "documents": docs,
        "benchmark": spark.createDataFrame([(1, " ".join(passage[:20])), (2, "one, TWO three"), (3, None), (4, ""), (6, "漢字")], "item_id long, text string"),
        "pages": spark.createDataFrame([(1, "u", "a"), (2, None, None), (3, "x", "é"), (4, "u", "a"), (5, "WARC/1.1", "a" * 3000), (6, "u", "")], "page_id long, url string, html string"),
        "conversations": spark.createDataFrame([(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "<s>"), (1, 1, "assistant", "<s>"), (2, None, "tool", None), (2, 5, None, "é\n[\\INST]"), (None, 0, "assistant", ""), (3, 0, "[ROLE]", "x")], "conv_id long, turn long, role string, text string"),
        "embeddings": spark.createDataFrame(
            [(k, [math.sin(k * j + j) for j in range(1, 5)], k % 3) for k in range(0, 330, 3)] + [(100, [0.5, 0.5, 0.5, 0.5], 1)] * 2 + [(None, [0.5, 0.5, 0.5, 0.5], 1), (200, None, 1), (300, [0.1, None, 0.2, 0.3], 1), (400, [1.0, 1.0, 1.0, 1.0], None), (500, [math.nan, 1.0, 1.0, 1.0], 1), (600, [math.inf, 1.0, 1.0, 1.0], 2)],
            "vec_id long, embedding array<float>, label int",
        ),
    }
    for table, df in tables.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    found = registry.queries()[name](spark, str(tmp_path))
    expected = duck(tables).sql(registry.oracle_sql()[name])
    assert sorted(found.columns) == sorted(expected.columns)
    order = ", ".join(sorted(found.columns))
    tidy = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    same(map(tidy, found.select(*sorted(found.columns)).collect()), [tidy(r) for r in duck(tables).sql(f"SELECT {order} FROM ({registry.oracle_sql()[name]})").fetchall()])


def test_mixing_by_brute_force(spark):
    r = random.Random(8)
    many = [(k, " ".join(words(r.randint(0, 60), k)) if k % 9 else None, r.choice(["a", "b", "c", None])) for k in range(120)] + [(7, "one row", "b")] * 40
    docs = spark.createDataFrame(many, "doc_id long, text string, source string").repartition(5)
    size = [len((t or "").split()) for _, t, _ in many]
    names = sorted({s for *_, s in many}, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    held = {s: sum(n for n, (*_, x) in zip(size, many) if x == s) for s in names}
    full = set()
    while True:
        level = (1.5 * sum(size) - sum(2 * held[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if 2 * held[s] <= level * weight[s]}
        if more <= full:
            break
        full |= more
    target = {s: min(2 * held[s], level * weight[s]) for s in names}
    order = sorted(range(len(many)), key=lambda i: hashlib.md5(f"42:{many[i][0]}:{many[i][1] or ''}".encode()).digest())
    turns, before = [], collections.Counter()
    for place, i in enumerate(order):
        s = many[i][2]
        before[s] += size[i]
        if size[i]:
            turns += [((before[s] + t * held[s]) / target[s], s is None, s or "", place, t, i) for t in (0, 1)]
    used, taken = 0, collections.Counter()
    for *_, i in sorted(turns):
        used += size[i]
        if used > math.floor(sum(target.values()) + 1e-3):
            break
        taken[i] += size[i]
    expected = [(many[i][0], size[i], held[many[i][2]], round(target[many[i][2]], 6), taken[i]) for i in range(len(many))]
    found = [(x.doc_id, x["size"], x.source_size, round(x.target, 6), x.taken) for x in mixing.mix(docs).collect()]
    same(found, expected)
    for s in names:
        assert abs(sum(taken[i] for i in range(len(many)) if many[i][2] == s) - target[s]) <= 2 * max(size)


def test_weak_spots_of_tables(spark):
    """Every operator takes a table of one row and of equal rows."""
    for many in (["one two three four five six"], ["a b c d e f"] * 6):
        check_all(spark, many)
    empty = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in quality.judge(empty).select("doc_id", "n_words", "kept").collect()] == [(1, 0, False)]
    assert warc.records(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
