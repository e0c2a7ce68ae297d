"""The trained models against plain versions: addresses and languages."""

import collections
import math
import random

import pytest

from lithograph.llm import language, urls


def grams(hosts, paths):
    """(address, (kind, n, n-gram)) in the order in which features come."""
    return [(i, (kind, n, t[k:k + n])) for kind, many in enumerate((hosts, paths)) for n in urls.GRAMS for i, x in enumerate(many) for t in [f"^{x}$"] for k in range(len(t) - n + 1)]


def parts(url):
    head, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    stop = min([path.index(c) for c in "?#" if c in path], default=len(path))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path[:stop]


def judged(host, path):
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best


def test_url_features_are_functions_of_their_grams():
    r = random.Random(1)
    hosts = ["".join(r.choices("ab.é𝄞", k=r.randint(0, 12))) for _ in range(60)] + ["", "x"]
    paths = ["".join(r.choices("/ab-1", k=r.randint(0, 20))) for _ in range(60)] + ["", "/" + "ab" * 40_000]
    row, bucket = urls.features(hosts, paths)
    expected = collections.defaultdict(list)
    for i, g in grams(hosts, paths):
        expected[i].append(g)
    found = collections.defaultdict(list)
    for i, b in zip(row.tolist(), bucket.tolist()):
        found[i].append(b)
    table = {}
    for i, gs in expected.items():
        assert len(gs) == len(found[i])
        for g, b in zip(gs, found[i]):
            assert table.setdefault(g, b) == b
    assert len(set(table.values())) > 0.97 * len(table)  # hashed into 65,536 weights


def plain_model(addresses, blocked, rounds, rate=4.0, decay=1e-3):
    """The same descent over dictionaries."""
    row, bucket = urls.features([h for h, _ in addresses], [p for _, p in addresses])
    own = [collections.Counter() for _ in addresses]
    for i, b in zip(row.tolist(), bucket.tolist()):
        own[i][b] += 1
    scale = [1 / math.sqrt(max(sum(c.values()), 1)) for c in own]
    weights, bias = collections.defaultdict(float), -1.0
    for _ in range(rounds):
        errors = [1 / (1 + math.exp(-(sum(weights[b] * n for b, n in c.items()) * s + bias))) - y for c, s, y in zip(own, scale, blocked)]
        gradient = collections.defaultdict(float)
        for c, s, e in zip(own, scale, errors):
            for b, n in c.items():
                gradient[b] += e * s * n / len(own)
        weights = collections.defaultdict(float, {b: w - rate * (gradient[b] + decay * w) for b, w in {**dict.fromkeys(gradient, 0.0), **weights}.items()})
        bias -= rate * (sum(errors) / len(errors) + 0.02)
    return weights, bias


def test_url_model_is_the_plain_descent():
    data = [(parts(u), y) for u, y in [(u, False) for u in urls.ALLOWED] + [(u, True) for u in urls.BLOCKED]]
    addresses, blocked = [a for a, _ in data], [y for _, y in data]
    model = urls.UrlModel(addresses, blocked, rounds=25)
    weights, bias = plain_model(addresses, blocked, 25)
    assert model.bias == pytest.approx(bias) and all(model.weights[b] == pytest.approx(w, abs=1e-9) for b, w in weights.items())
    assert (model.weights != 0).sum() == sum(w != 0 for w in weights.values())
    # Its loss falls, and along the gradient: a step against it does not raise the loss.
    loss = lambda m: -sum(math.log(p if y else 1 - p) for p, y in zip(m.predict([h for h, _ in addresses], [p for _, p in addresses]), blocked))
    losses = [loss(urls.UrlModel(addresses, blocked, rounds=k)) for k in (0, 5, 25, 100)]
    assert losses == sorted(losses, reverse=True)


def test_url_verdicts(spark, tmp_path):
    r = random.Random(2)
    hosts = ["example.com", "a.example.com", "x.net", "example.net", "b.example.net", "shop.org", "WWW.Example.COM", "com", "notexample.com", "casino-bonus.info", "quiet.info"]
    rows = [(k, r.choice(["http://", "https://", "", "x://"]) + r.choice(hosts) + r.choice(["/en/7", "/en/", "/de/8x", "/de/1", "/es/a", "", "/poker/jackpot/free", "?q=/en/", "#/de/"])) for k in range(300)] + [(None, None), (7, "://"), (8, "no scheme"), (9, "http://casino-poker-jackpot.info/free-slots/xxx")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    model = urls.train_url_model(urls.labelled_urls(spark))
    expected = collections.Counter()
    for i, url in rows:
        host, path = parts(url)
        rule = judged(host, path)
        verdict = rule[1] if rule else "block" if model.predict([host], [path])[0] >= 0.5 else "allow"
        expected[i, host, path, rule[0] if rule else None, verdict] += 1
    out = urls.op1_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict").collect()
    assert collections.Counter(map(tuple, out)) == expected
    assert {k[4] for k in expected if k[3] is None} == {"allow", "block"}  # the model decides both ways


def test_fusion_decides_where_the_text_is_short_or_mixed(spark):
    """Accuracy on held-out short texts: all evidence together beats the text alone, and never by the other evidence on plain texts."""
    r = random.Random(3)
    letters = {"xx": "abcdefgh", "yy": "efghijkl"}  # half of the letters are common
    word = lambda lang: "".join(r.choices(letters[lang], k=r.randint(2, 5)))
    docs = [(lang, " ".join(word(lang) for _ in range(400))) for lang in letters for _ in range(10)]
    pages, truth = [], {}
    for k in range(400):
        lang = "xx" if k % 2 else "yy"
        words = [word(lang) for _ in range(2 if k % 4 < 2 else 60)]
        if k % 20 < 2:
            words = ["ef"]  # no letter tells
        truth[k] = lang
        declared = f' lang="{lang}"' if k % 3 else ""
        pages.append((k, f"http://host{lang}{k % 5}.example/{k}", f"<html{declared}><p>{' '.join(words)}</p></html>"))
    found = language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "lang string, text string")).collect()
    alone = sum(x.text_lang == truth[x.page_id] for x in found)
    fused = sum(x.lang == truth[x.page_id] for x in found)
    corrected = [x.page_id for x in found if x.text_lang != truth[x.page_id] and x.lang == truth[x.page_id]]
    spoiled = [x.page_id for x in found if x.text_lang == truth[x.page_id] and x.lang != truth[x.page_id]]
    assert len(found) == 400 and fused > alone and fused >= 390 and len(corrected) >= 10 and not spoiled
    short = [x.posterior for x in found if x.page_id % 20 < 2]
    plain = [x.posterior for x in found if x.page_id % 4 >= 2 and x.page_id % 20 >= 2]
    assert max(short) < 1.0 and sum(short) / len(short) < sum(plain) / len(plain)


def test_context_tree_counts_small_nodes_from_tables_and_sorts_paths_once(monkeypatch):
    """Weights of more than two bytes, values back in place over several slabs, and no logarithm of gamma for small counts."""
    import numpy as np

    from lithograph.llm import ctw

    texts = [b"", b"abc", b"Abc abd", b"x" * 300, bytes(range(256)) * 300]
    weights = np.array([3, 0, 70_000, (1 << 40) + 5, 65_536])
    want: collections.Counter = collections.Counter()
    for text, weight in zip(texts, weights.tolist()):
        raw = ctw.PAD + bytes(ctw.C.LOWER[np.frombuffer(text, np.uint8)]) + b"\0"
        for at in range(ctw.DEPTH, len(raw)):
            want[sum(raw[at - d] << (8 * (ctw.DEPTH + 1 - d)) for d in range(1, ctw.DEPTH + 1)) | raw[at]] += weight
    monkeypatch.setattr(ctw, "MERGE_KEYS", 1000)
    keys, counts = ctw.path_counts(texts, weights)
    assert dict(zip(keys.tolist(), counts.tolist())) == want and (np.diff(keys.astype(np.int64)) > 0).all()
    assert (ctw.distinct_paths(texts) == keys).all() and len(ctw.path_counts([], weights[:0])[0]) == 0
    at = np.random.default_rng(1).permutation(np.repeat(keys, 600))
    assert len(at) > 2 * 65536 and (ctw.path_values(at, keys, counts) == counts[np.searchsorted(keys, at)]).all()
    n = np.array([0.0, 1, 5, 4095, 4096, 1e6])
    assert np.allclose(ctw._log_kt(n, n[::-1]), [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(n, n[::-1])])
    seen = []
    found = ctw._log_gamma
    monkeypatch.setattr(ctw, "_log_gamma", lambda x: seen.append(len(x)) or found(x))
    list(ctw.Subtrees(ctw._path_table(0, *ctw.path_counts(texts[:3], np.ones(3, np.int64)), 1)["payload"].to_pylist()).decisions())
    assert sum(seen) == 0
