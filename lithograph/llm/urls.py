"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

A rule has a host, a path prefix and a verdict.  It fits its host and all subdomains if
the address's path starts with the rule's; of several the longest wins.  Rules are a short
list that becomes one expression.  Addresses without a rule are judged by a model: n-grams
of 3 to 5 characters of host and path, hashed into a fixed number of weights, trained by
gradient descent on a small labelled table (``max_rows`` of it at most).

Defined results
    * null, or no ``://``: host and path are empty and the model judges the empty address;
    * repeated rows are judged alike; extra columns stay, but for those named like a result
      (host, path, rule, p_block, verdict), which the result replaces;
    * an empty table gives an empty result; a model without training rows allows all.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm import chunks as C

# Fixed values: (host, path prefix, verdict).
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)

# The labelled addresses the model learns from.
ALLOWED = (
    "https://www.cityjournal.example/world/2021/05/budget-vote.html", "https://docs.sparrowdb.example/guide/install/", "https://blog.maria-cooks.example/soup/leek-and-potato",
    "https://en.openfacts.example/wiki/River_delta", "http://www.university.example/courses/algebra/notes3.html", "https://library.example/catalogue/item/48213",
    "https://forum.gardeners.example/t/pruning-roses/1290", "https://www.museum.example/exhibitions/spring", "https://news.harbour.example/de/wirtschaft/4512.html",
    "https://m.weather.example/fr/paris", "https://shop.bookbarn.example/item/9781400", "https://www.theatre.example/es/programa/2024", "https://blog.example.com/en/22152",
    "https://www.station.example.net/fr/34998", "http://press.example.org/de/1840.html", "https://research.example.edu/papers/optics-17.pdf", "https://recipes.example.org/bread/rye",
    "https://help.mailer.example/article/reset-password", "https://www.council.example.gov/minutes/2019-11", "https://code.example.io/projects/parser/readme", "https://maps.example.net/en/route/88",
    "https://www.runner.example.com/fr/49156/", "https://travel.example.org/es/madrid/guide.html", "https://history.example.net/en/40137/", "https://science.example.com/de/7781",
    "https://podcast.example.org/episodes/112", "https://www.clinic.example/opening-hours", "https://school.example.edu/timetable/week/12", "https://music.example.net/album/quartets", "https://www.example.com/about",
)
BLOCKED = (
    "http://free-casino-bonus.example/slots/jackpot-win.html", "https://www.hot-adult-cams.example/live/xxx", "http://cheap-pills-online.example/buy/viagra-no-prescription", "https://poker-jackpot.example/bonus/free-spins",
    "http://xxx-tube.example/porn/video/8812", "https://best-casino.example/en/slots", "http://warez-crack.example/download/keygen-serial.exe", "https://torrent-free-movies.example/download/cam-rip",
    "https://sexy-dating.example/adult/singles", "http://replica-watches-sale.example/cheap/rolex", "https://pills24.example/order/cialis-cheap", "http://win-prize-now.example/claim/free-iphone?click=1",
    "https://adult.example.com/xxx/gallery", "http://bet365-bonus.example/betting/odds-free", "https://crack-serials.example/keygen/office", "http://payday-loan-fast.example/apply/cash-now",
    "https://porn.example.net/sex/free", "http://casino.example.org/poker/bonus", "https://escort-adult.example/sexy/book", "http://miracle-weight-loss.example/buy/pills-discount", "https://slots.example.com/jackpot/spin",
    "http://clickbait-offers.example/win/prize-free-gift", "https://nude-cams.example/live/adult", "http://cheap-seo-links.example/buy/backlinks", "https://gambling.example.net/betting/casino", "http://hack-tool.example/crack/download.exe",
    "https://viagra.example.org/cheap/order", "http://xxx.example.com/porn/cams", "https://free-porn.example/video/sex.html", "http://loan-cash.example.net/payday/apply",
)

GRAMS = (3, 4, 5)
BUCKETS = 1 << 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return host, path


def apply_rules(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, its verdict), null where no rule fits; the longest is tried first."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if rule is None else (rule, verdict)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(address, bucket) of every n-gram; host and path have marks of their own at both ends."""
    rows, buckets = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for kind, many in enumerate((hosts, paths)):
        texts = [f"^{t}$".encode("utf-32-le", "surrogatepass") for t in many]
        for lo, hi in C.blocks(texts):
            raw = np.frombuffer(b"".join(texts[lo:hi]), np.uint32)
            ends = np.cumsum([0, *(len(t) // 4 for t in texts[lo:hi])])
            for n in GRAMS:
                at, text = C.window_starts(ends, n)
                hashes = C.rolling(raw.astype(np.uint64) + np.uint64(1), n, 2 * n + kind)
                rows.append(text + lo)
                buckets.append((hashes[at] % np.uint64(BUCKETS)).astype(np.int64) if len(at) else np.empty(0, np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


class UrlModel:
    """Logistic regression; features of an address are scaled to unit length."""

    def __init__(self, urls: list[tuple[str, str]], blocked: list[bool], rounds: int = 300, rate: float = 4.0, decay: float = 1e-3):
        self.weights, self.bias = np.zeros(BUCKETS, np.float64), -1.0
        if not urls:
            return
        row, bucket = features([h for h, _ in urls], [p for _, p in urls])
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=len(urls)), 1))
        label = np.array(blocked, np.float64)
        for _ in range(rounds):
            error = self._sigmoid(self._sums(row, bucket, len(urls))) - label
            gradient = np.bincount(bucket, (error * scale)[row], BUCKETS) / len(urls)
            self.weights -= rate * (gradient + decay * self.weights)
            self.bias -= rate * (error.mean() + 0.02)  # in doubt, allow

    def _sums(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
        return np.bincount(row, self.weights[bucket], n) * scale + self.bias

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    def predict(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        return self._sigmoid(self._sums(*features(hosts, paths), len(hosts)))


def train_url_model(labelled: DataFrame, max_rows: int = 20_000) -> UrlModel:
    """From (url, blocked); at most ``max_rows`` rows, the first in the order of the addresses' hashes."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("blocked IS NOT NULL").select(host.alias("host"), path.alias("path"), "blocked").orderBy(F.xxhash64("url"), "blocked").limit(max_rows).collect()
    return UrlModel([(r.host, r.path) for r in rows], [bool(r.blocked) for r in rows])


def labelled_urls(spark) -> DataFrame:
    return spark.createDataFrame([(u, False) for u in ALLOWED] + [(u, True) for u in BLOCKED], "url string, blocked boolean")


def filter_urls(pages: DataFrame, model: UrlModel, rules=RULES, url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, p_block (null where a rule decides) and verdict."""
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumns({"host": host, "path": path})
    rule, said = apply_rules(F.col("host"), F.col("path"), rules)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series(model.predict(hosts.tolist(), paths.tolist()))

    out = out.withColumns({"rule": rule, "_said": said}).withColumn("p_block", score("host", "path"))
    verdict = F.coalesce(F.col("_said"), F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return out.withColumn("verdict", verdict).withColumn("p_block", F.when(F.col("rule").isNull(), F.col("p_block"))).drop("_said")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, train_url_model(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict", "p_block")
