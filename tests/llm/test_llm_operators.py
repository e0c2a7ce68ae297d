"""Every operator against brute force on a small table of awkward rows, and on an empty one."""

import base64
import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lithograph.llm import components, ctw, decontaminate, jaccard, language, mixing, quality, substring, suffix, urls, warc
from lithograph.llm.storage import new_path

#: Extra columns carry names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sha string, words string, kept string, size long, chunk long"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def rows():
    base, passage = words(120, 1), words(45, 2)
    near = base[:60] + ["changed"] + base[61:]
    long = words(9000, 3)
    texts = [
        (1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base)), (4, " ".join(words(80, 4) + passage + words(30, 5))), (5, " ".join(passage + words(60, 6))),
        (6, None), (7, ""), (8, " \n\t "), (9, "one two three"), (10, "ONE two\nthree"), (11, "wörd Ünïcode 漢字   mid"), (12, " ".join(long)),
        (13, " ".join(long[:4000] + ["x"] + long[4000:])), (14, "a b c d e f g h " * 12), (None, " ".join(base[::-1])), (15, " ".join(base) + " tail"), (1, " ".join(base)),
        (16, " ".join(words(50, 7)).upper()), (17, "the and of to in is that was with for " * 3 + " ".join(words(40, 8))), (18, " ".join(passage).upper()),
    ]
    return [(i, t, ["en", "de", None][k % 3], ["s1", "s2", None, "s3"][k % 4], None, "s", "w", "k", 5, k) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts():
    return [(r[0], (r[1] or "").encode()) for r in rows()]


def same(found, expected):
    assert collections.Counter(map(tuple, found)) == collections.Counter(expected)


def digest(raw):
    return hashlib.sha256(raw).hexdigest()


def test_jaccard(docs, empty):
    sets = []
    for _, t in texts():
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (doc, _) in enumerate(texts()):
        if doc is not None:
            ids[root(i)].append(doc)
    expected = [(doc, len(sets[i]), min(ids[root(i)], default=None) if sets[i] else doc) for i, (doc, _) in enumerate(texts())]
    same(jaccard.document_links(docs).drop("n_links").collect(), expected)
    assert jaccard.document_links(empty).count() == 0


def test_divide_skip_finds_every_link_across_blocks():
    import numpy as np

    r = random.Random(5)
    base = r.sample(range(10**6), 60)
    sets = [np.array(sorted({*base[: 60 - r.randint(0, 12)], *r.sample(range(10**6), r.randint(0, 8))}), np.uint64) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes = [sets[i] for i in order], sizes[order]
    links = {(i, j) for j in range(60) for i in range(j) if 100 * len({*sets[i].tolist()} & {*sets[j].tolist()}) >= 80 * len({*sets[i].tolist()} | {*sets[j].tolist()})}

    def parts(edges):
        up = list(range(60))

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in edges:
            up[root(a)] = root(b)
        return len({root(i) for i in range(60)})

    assert links and parts(jaccard.divide_skip(sizes, sets, np.zeros(60, int), 80)) == parts(links)
    side = np.arange(60) % 2
    across = [(i, j) for i, j in links if side[i] != side[j]]
    assert parts(jaccard.divide_skip(sizes, sets, side, 80)) == parts(across)


def test_jaccard_in_blocks(docs, monkeypatch):
    whole = jaccard.document_links(docs).collect()
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 100)
    same(jaccard.document_links(docs).collect(), [tuple(r) for r in whole])


@pytest.mark.parametrize("block", [None, 300])
def test_jaccard_counts_every_link(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    r, base = random.Random(31), words(80, 30)
    near = [" ".join(base[:k] + ["x" + str(k)] + base[k + 1 :]) for k in range(2, 78, 6)]
    many = [" ".join(base), " ".join(base).upper(), *near, near[0], near[0], *(" ".join(words(30, 50 + k)) for k in range(4)), "", "  ", None, "one two", "one two"]
    r.shuffle(many)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := (t or "").lower().split()) > 4 else {tuple(w)} if w else set() for t in many]
    expected = [(i, len(a), sum(bool(a and b) and 100 * len(a & b) >= 80 * len(a | b) for j, b in enumerate(sets) if i != j)) for i, a in enumerate(sets)]
    found = jaccard.document_links(spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(3))
    assert max(n for *_, n in expected) > 10
    same(found.select("doc_id", "n_shingles", "n_links").collect(), expected)


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)]
    up = list(range(200))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    found = components.components(spark.createDataFrame(edges, "u long, v long")).collect()
    same(found, [(n, root(n)) for n in {n for e in edges if e[0] != e[1] for n in e}])


def test_substring(docs, empty):
    counts = collections.Counter()
    for _, t in texts():
        w = t.split()
        counts.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    expected = []
    for doc, t in texts():
        w = t.split()
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if counts[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        expected.append((doc, len(w), sum(gone), digest(b" ".join(x for x, g in zip(w, gone) if not g))))
    found = substring.substring_dedup(docs).select("sha", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    from lithograph.llm.chunks import attach

    same(attach(docs, found).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), expected)
    assert substring.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    order = sorted(texts(), key=lambda r: (r[0] is None, r[0] or 0))
    first = {}
    for doc, t in order:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], doc)
    expected = []
    for doc, t in texts():
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            least = first[t[k : k + 50]]
            if least is not None and (doc is None or least < doc):
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        expected.append((doc, len(t), sum(gone), spans, digest(bytes(c for c, g in zip(t, gone) if not g))))
    same(suffix._per_document(docs).collect(), expected)
    assert suffix._per_document(empty).count() == 0


def test_suffix_sort_orders_by_bytes():
    import numpy as np

    raw = np.frombuffer(("abracadabra" * 30).encode(), np.uint8)
    held = suffix.Suffixes(raw, 12)
    at = np.arange(len(raw) - 12)
    order = held.sort(at, np.zeros(len(at), np.int64))
    sorted_ = [raw[i : i + 12].tobytes() for i in at[order]]
    assert sorted_ == sorted(sorted_)
    label = held.classes(at, np.zeros(len(at), np.int64))
    assert len(set(label.tolist())) == len(set(sorted_))


def test_quality(docs, empty):
    expected = []
    for doc, t in texts():
        text = t.decode()
        w = [x.decode() for x in t.split()]
        counts = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = [False] * len(w)
        for k in range(len(w) - 7):
            if counts[tuple(w[k : k + 8])] > 1:
                hit[k : k + 8] = [True] * 8
        lines = [x for x in text.split("\n") if x.encode().split()]
        expected.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(hit), len(w) < 20 or 100 * sum(hit) > 30 * len(w)))
    judged = quality.judge(docs.select("doc_id", "text", "kept"))
    same(judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), expected)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns and kept.count() == judged.where("kept").count() and {r.kept for r in kept.collect()} <= {"k"}
    assert quality.judge(empty).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix(docs, budget_ratio=1.5)
    found = out.collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    assert len(found) == docs.count()
    total = sum(r["size"] for r in found)
    targets = {r.source: r.target for r in found}
    sizes = {r.source: r.source_size for r in found}
    assert sum(targets.values()) == pytest.approx(min(1.5 * total, 2 * total))
    assert all(targets[s] <= 2 * sizes[s] + 1e-6 for s in targets)
    taken = collections.Counter()
    for r in found:
        assert r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    largest = max(r["size"] for r in found)
    assert sum(taken.values()) <= 1.5 * total and all(abs(taken[s] - targets[s]) <= 2 * largest for s in targets)
    assert mixing.mix(empty).count() == 0


def test_decontamination(spark, docs, empty):
    passage = words(45, 2)
    items = [(1, " ".join(passage[:20])), (2, "one, TWO three"), (3, None), (4, ""), (5, " ".join(words(30, 99))), (5, " ".join(passage[5:15])), (None, " ".join(words(120, 1)[10:25])), (6, "漢字")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    import re

    def split(t):
        lower = t.translate({c: c + 32 for c in range(65, 91)})
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)

    windows = []
    for i, t in items:
        w = split(t or "")
        windows += [(i, w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    expected = []
    for doc, t in texts():
        w = split(t.decode())
        hit, ids = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    if i is not None:
                        ids.add(str(i))
        expected.append((doc, len(w), len(hit), len(ids), digest(",".join(sorted(ids)).encode()), bool(hit)))
    assert any(e[5] for e in expected)
    same(decontaminate._per_document(docs, benchmark).collect(), expected)
    assert decontaminate._per_document(empty, benchmark).count() == 0
    assert not decontaminate._per_document(docs, benchmark.limit(0)).where("contaminated").count()


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    benchmark = spark.createDataFrame([(1, " ".join(words(45, 2)))], "item_id long, text string")
    whole = decontaminate._per_document(docs, benchmark).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_SHINGLES", 10)
    same(decontaminate._per_document(docs, benchmark).collect(), [tuple(r) for r in whole])


def test_ctw(docs, empty):
    split = {k: [*t.lower().split(), b"\0end"] for k, (_, t) in enumerate(texts())}
    out = {k: zlib.crc32((str(d) if d is not None else "").encode()) % 7 == 2 for k, (d, _) in enumerate(texts())}
    counts = collections.Counter(w for k, ws in split.items() if not out[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter((d, out[k], len(split[k]), sum(counts[w] > 0 for w in split[k]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in split[k]), 6)) for k, (d, _) in enumerate(texts()))
    found = ctw.score_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == expected
    assert all(r.score < 0 for r in found)
    assert ctw.score_documents(empty).count() == 0


def test_ctw_probabilities_sum_to_one():
    import numpy as np

    data = b"abracadabra abracadabra"
    keys, counts = np.unique(ctw._keys(*ctw._sequence([data])), return_counts=True)
    model = ctw.Model(keys.astype(np.int64), counts.astype(float))
    assert np.allclose((10.0 ** model.logs.astype(float)).sum(axis=1), 1, atol=1e-4)
    assert model.score([data])[0] > model.score([b"zqzqzqzqzqzqzqzqzqzqzqz"])[0]


def test_ctw_mixes_all_depths(spark):
    r = random.Random(12)
    vocab = ["".join(r.choice("abc") for _ in range(r.randint(2, 9))) for _ in range(12)]
    many = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 60))) for _ in range(24)] + ["zzq wörd", ""]
    table = spark.createDataFrame(list(enumerate(many)) + [(99, many[0])], "doc_id long, text string").repartition(3)
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in [*range(len(many)), 99]}

    def steps(text):
        raw = b"\0" * ctw.DEPTH + text.lower().encode() + b"\0"
        for at in range(ctw.DEPTH, len(raw)):
            for bit in range(8):
                yield [(raw[at - d : at], bit, raw[at] >> (8 - bit)) for d in range(ctw.DEPTH + 1)], (raw[at] >> (7 - bit)) & 1

    counts, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
    for i, held in out.items():
        for path, one in [] if held else steps(many[i % 99]):
            for above, node in zip([None, *path], path):
                counts[node][one] += 1
                children[above].add(node)

    def kt(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    stay = {}

    def weighted(node):
        if len(node[0]) == ctw.DEPTH:
            return kt(node)
        own, below = kt(node), sum(map(weighted, children[node]))
        every = max(own, below) + math.log1p(math.exp(-abs(own - below)))
        stay[node] = math.exp(own - every)
        return every - math.log(2)

    for node in children[None]:
        weighted(node)

    def log_probability(text):
        total = 0.0
        for path, one in steps(text):
            known = [n for n in path if n in counts] or path[:1]
            p = None
            for node in reversed(known):
                a, b = counts[node] if node in counts else (0, 0)
                own = ((a, b)[one] + 0.5) / (a + b + 1)
                p = own if p is None else stay[node] * own + (1 - stay[node]) * p
            total += math.log10(p)
        return total

    assert ctw.DEPTH >= 5
    for row in ctw.score_documents(table).collect():
        assert math.isclose(row.score, log_probability(many[row.doc_id % 99]), rel_tol=1e-5, abs_tol=1e-4)


def test_warc(spark):
    pages = [
        (1, "u", "a WARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n x"), (2, None, None), (3, "x\r\ny", "é"), (4, "u", "a"), (5, "u", "a"), (None, "u", "a"),
        (6, "u", ""), (7, "u", "WARC/1.1\r\n"), (8, "u", "z" * 100), (8, "u", "z" * 100), (9, "u", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"),
        (10, "http://x/WARC/1.1", "one"), (11, "http://x/\u2028Content-Length: 0", "two"), (12, "WARC/1.1\r\nWARC/1.1", "three"), (13, "\nWARC/1.1\r\n", "four\r\n"), (14, "\u0085Content-Length: 0\r", "\r\n\r\n"),
        (15, "u", "x\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\ny\r\n\r\n"), (16, "u", "\nWARC/1.1"), (17, "u", "\nWARC/1.1\r\n" * 40),
    ]
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = []
    for i, _, h in pages:
        raw, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", f if again else None))
    table = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, payload string, offset int")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for compression, part in (("gzip", before), ("none", "300")):
        path = new_path(spark, "test")
        warc.write_archives(table.coalesce(1), path, compression=compression)
        spark.conf.set("spark.sql.files.maxPartitionBytes", part)
        same(warc.read_archives(spark, path).select(*columns).collect(), expected)
        assert warc.read_archives(spark, path).where("NOT intact").count() == 0
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    path = new_path(spark, "test")
    warc.write_archives(table.limit(0), path)
    assert warc.read_archives(spark, path).count() == 0


def test_warc_payloads_around_the_separator(spark):
    """Payloads that are, begin with or end in the separator or a part of it, as first, middle and last record of a file."""
    parts = [warc.SEPARATOR, warc.MAGIC, "WARC/1.1\r", "WARC/1.1", "\n", "\r\n", "\r\n\r", "\r\n\r\n", "\r\n\r\nWARC/1.1\r\n", "\r\n\r" + warc.SEPARATOR]
    awkward = parts + [p + "tail" for p in parts] + ["lead" + p for p in parts] + [warc.MAGIC * 3, warc.SEPARATOR * 3, warc.MAGIC + "x" * 1_200_000 + warc.SEPARATOR]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for compression, part in (("gzip", before), ("none", "300")):
        for where in ("first", "middle", "last") if compression == "gzip" else ("middle",):
            path, pages = new_path(spark, "test"), []
            for k, html in enumerate(awkward if compression == "gzip" else awkward[:-1]):
                around = {"first": (), "middle": (f"before{k}",), "last": (f"before{k}", f"also{k}")}[where], {"first": (f"after{k}",), "middle": (f"after{k}",), "last": ()}[where]
                pages += [(k * 10 + n, h) for n, h in enumerate((*around[0], html, *around[1]))]
            schema = "page_id long, html string"
            held = spark.createDataFrame(pages, schema).selectExpr("page_id", "'u' AS url", "html")
            # One file for each awkward payload, or one for all.
            if where == "middle":
                warc.write_archives(held.coalesce(1), path, compression=compression)
            else:
                warc.write_archives(held.repartition(2), path, compression=compression)
                for k in (1, len(awkward) - 1):
                    warc.write_archives(held.where(F.col("page_id").between(k * 10, k * 10 + 9)).orderBy("page_id").coalesce(1), f"{path}-{k}", compression=compression)
                    assert warc.read_archives(spark, f"{path}-{k}").count() == sum(k * 10 <= i <= k * 10 + 9 for i, _ in pages)
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            found = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            assert len(found) == len(pages)
            for i, html in pages:
                assert found[i].payload_bytes == len(html.encode()) and found[i].payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() and found[i].intact


def test_urls(spark):
    pages = [(1, "https://Example.COM/en/7x?q#f"), (2, "http://a.example.net/de/81"), (3, "http://x.net/de/1"), (4, None), (5, "no scheme"), (6, "ftp://org"), (6, "ftp://org"), (7, "http://notcom/en/1"), (8, "http://a.com/en/" + "y" * 5000)]
    table = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, host string")
    model = urls.train_url_model(urls.labelled_urls(spark))
    found = urls.filter_urls(table, model).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found}
    assert len(found) == len(pages)
    assert by[1] == ("example.com", "/en/7x", "example.com/en/7", "allow") and by[2][2:] == ("example.net/de/8", "block") and by[3][2:] == ("net/de/", "allow")
    assert by[4][:3] == ("", "", None) and by[5][:3] == ("", "", None) and by[6][:2] == ("org", "") and by[7][2] is None and by[8][2:] == ("com/en/", "block")
    assert urls.filter_urls(table.limit(0), model).count() == 0
    assert urls.UrlModel([], []).predict(["x"], ["/"])[0] < 0.5


def test_url_model_on_held_out_rows():
    import re

    def parts(u):
        host, path = re.match(r"[^:]*://([^/?#]*)([^?#]*)", u).groups()
        return host, path

    right = total = 0
    for fold in range(5):
        many = [(u, False) for u in urls.ALLOWED] + [(u, True) for u in urls.BLOCKED]
        train = [x for k, x in enumerate(many) if k % 5 != fold]
        test = [x for k, x in enumerate(many) if k % 5 == fold]
        model = urls.UrlModel([parts(u) for u, _ in train], [b for _, b in train])
        said = model.predict(*zip(*(parts(u) for u, _ in test))) >= 0.5
        right += sum(int(s == b) for s, (_, b) in zip(said, test))
        total += len(test)
    assert right / total >= 0.75


def test_language(spark, empty):
    known = spark.createDataFrame([("en", "the cat and the dog sat on the mat with the hat " * 5), ("de", "der hund und die katze sind auf dem dach und nicht im haus " * 5), (None, "x"), ("en", None)], "lang string, text string")
    pages = [
        (1, "http://a.de/x", '<html lang="de"><p>die katze und der hund</p></html>'), (2, "http://b.com/", "<html><script>der die das und</script><p>the dog and the cat</p></html>"),
        (3, None, None), (4, "http://a.de/y", ""), (2, "http://b.com/", "<p>the hat on the mat</p>"),
    ]
    table = spark.createDataFrame([(*p, "zz") for p in pages], "page_id long, url string, html string, lang string")
    found = language.identify(table, known).collect()
    assert len(found) == len(pages)
    assert {r.page_id: r.lang for r in found if r.page_id in (1, 2, 4)} == {1: "de", 2: "en", 4: "de"}
    assert language.identify(table.limit(0), known).count() == 0
    assert language.identify(table, known.limit(0)).where("lang IS NOT NULL").count() == 0
