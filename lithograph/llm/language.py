"""Language identification of pages by Bayesian fusion of evidence.

Four kinds of evidence are multiplied for each language:

* the text: byte trigrams, with likelihoods from all labelled documents;
* the language that the markup declares, by how often pages whose text is in a language
  declare it;
* the last label of the host, likewise;
* the host: a prior that is smoothed towards its domain, which is smoothed towards all pages.

The last three are grouped sums of the pages' text posteriors, so a host with a third of all
pages is a partial sum like any other.  A page's own posterior is taken out of the sums that
judge it (leave one out), so its text counts once.  Neighbouring trigrams overlap: one in
three of a text's counts as independent, and ``TEXT_WEIGHT`` at most, so that the text of a
page decides where it is plain and the other evidence where it is short or mixed.

Languages are taken in blocks of ``LANGUAGE_BLOCK``: at most so many times ``BUCKETS`` counts
reach the driver at once, and a broadcast is 8 MB at most, however many languages there are;
each block is a pass over documents and pages.

Defined results
    * null url or html: the evidence that is there decides; without any, the commonest language;
    * documents without a language or text teach nothing; no labelled documents: null languages;
    * ties (of logarithms to nine digits) go to the language first in code-point order;
    * repeated rows each have a result, and are other pages to each other;
    * very long texts are read whole, in pieces of 256 KB;
    * extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.llm import chunks as C
from lithograph.llm.storage import stash
from lithograph.llm.urls import host_and_path

#: Hash buckets of trigrams, and languages of one pass.
BUCKETS = 1 << 14
LANGUAGE_BLOCK = 128
#: Trigrams of a text count as this many independent ones at most.
TEXT_WEIGHT = 20.0
#: Pages that a smoothing prior counts as.
PRIOR_PAGES = 5.0

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256), 32]] = True


def trigrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every byte trigram without a digit or mark in it, a block at a time.

    A-Z are lowered; a text has a space at either end.
    """

    def emit(pieces: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        raw = C.LOWER[np.frombuffer(b"".join(p for _, p in pieces), np.uint8)]
        sizes = np.array([len(p) for _, p in pieces])
        inside = np.ones(len(raw), bool)
        ends = np.cumsum(sizes)
        inside[ends - 1] = inside[np.maximum(ends - 2, 0)] = False
        letter = _LETTER[raw]
        at = np.flatnonzero(inside[:-2] & letter[:-2] & letter[1:-1] & letter[2:])
        wide = raw.astype(np.uint64)
        code = C.mix((wide[at] << np.uint64(16)) | (wide[at + 1] << np.uint64(8)) | wide[at + 2])
        owner = np.repeat(np.array([i for i, _ in pieces]), sizes)
        return owner[at], (code % np.uint64(BUCKETS)).astype(np.int64)

    held: list[tuple[int, bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        padded = b" " + text + b" "
        for k in range(0, max(1, len(padded) - 2), C.BLOCK_BYTES):
            piece = padded[k : k + C.BLOCK_BYTES + 2]
            if held and size + len(piece) > C.BLOCK_BYTES:
                yield emit(held)
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
    if held:
        yield emit(held)


def train(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """Log likelihoods (language, bucket) from (lang, text as bytes)."""
    place = {lang: i for i, lang in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(langs) * BUCKETS, np.int64)
        for batch in batches:
            own = np.array([place[x] for x in batch["lang"].to_pylist()], np.int64)
            for row, bucket in trigrams(batch["text"].to_pylist()):
                key, n = np.unique(own[row] * BUCKETS + bucket, return_counts=True)
                table[key] += n
        key = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(table[key])], names=["key", "n"])

    sums = rows.where(F.col("lang").isin(langs)).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((len(langs), BUCKETS), 0.5)
    np.add.at(table.reshape(-1), sums["key"].to_numpy(), sums["n"].to_numpy())
    return np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def score(texts: list[bytes], model: np.ndarray) -> np.ndarray:
    """(text, language): log likelihoods of the trigrams that count."""
    sums, size = np.zeros((len(texts), len(model))), np.zeros(len(texts))
    for row, bucket in trigrams(texts):
        if len(row):
            first = int(row[0])
            span = slice(first, int(row[-1]) + 1)
            size[span] += np.bincount(row - first)
            for lang, weights in enumerate(model):
                sums[span, lang] += np.bincount(row - first, weights[bucket])
    return sums * (np.minimum(size / 3, TEXT_WEIGHT) / np.maximum(size, 1))[:, None]


def declared_language(html: Column) -> Column:
    tag = F.regexp_extract(html, r"(?is)<html\b([^>]*)>", 1)
    return F.lower(F.regexp_extract(tag, r"""(?i)\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>|&#?\w{1,8};", " ")


def _text_scores(pages: DataFrame, documents: DataFrame, langs: list[str]) -> DataFrame:
    """page_id, host, declared, suffix, domain and text_logs: scores of the text by language."""
    known = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.col("text").cast("binary").alias("text"))
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), declared_language(F.coalesce("html", F.lit(""))).alias("declared"), visible_text(F.col("html")).cast("binary").alias("visible"), F.array().cast("array<double>").alias("text_logs"))
    for lo in range(0, len(langs), LANGUAGE_BLOCK):
        model = pages.sparkSession.sparkContext.broadcast(train(known, langs[lo : lo + LANGUAGE_BLOCK]))

        @F.arrow_udf("array<double>")
        def likelihoods(texts: pa.Array) -> pa.Array:
            return pa.array(score([t or b"" for t in texts.to_pylist()], model.value).tolist(), pa.list_(pa.float64()))

        rows = rows.withColumn("text_logs", F.concat("text_logs", likelihoods("visible")))
        rows = stash(rows.drop("visible") if lo + LANGUAGE_BLOCK >= len(langs) else rows, "pages")
    return rows.withColumn("suffix", F.regexp_extract("host", r"\.([a-z]{2,})$", 1)).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, host, declared, suffix, text_lang, lang and its posterior."""
    langs = sorted(r[0] for r in documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang").distinct().collect())
    if not langs:
        return pages.select("page_id", *(F.lit(None).cast("string").alias(c) for c in ("host", "declared", "suffix", "text_lang", "lang")), F.lit(None).cast("double").alias("posterior"))
    n = len(langs)
    rows = _text_scores(pages, documents, langs)
    total = lambda many: F.aggregate(many, F.lit(0.0), lambda a, x: a + x)
    likely = F.transform("text_logs", lambda x: F.exp(x - F.array_max("text_logs")))
    rows = rows.withColumn("likely", likely).withColumn("p", F.transform("likely", lambda x: x / total("likely"))).drop("likely")

    sums = F.array(*(F.sum(F.col("p")[i]) for i in range(n)))
    every = rows.agg(*(F.coalesce(F.sum(F.col("p")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(n)), F.count("*").alias("pages")).first()
    overall = F.array(*(F.lit(float(every[f"s{i}"])) for i in range(n)))

    def by(column: str) -> DataFrame:
        """The sums of a column's values, and how many values there are."""
        table = rows.groupBy(column).agg(sums.alias(f"{column}_s"), F.count("*").alias(f"{column}_n"))
        if column in ("host", "domain"):
            return table
        return table.drop(f"{column}_n").crossJoin(F.broadcast(table.agg(F.count("*").cast("double").alias(f"{column}_n"))))

    out = rows
    for column in ("host", "domain", "declared", "suffix"):
        out = out.join(by(column), column)

    def others(own: Column) -> Column:
        """Sums without the page's own part."""
        return F.zip_with(own, F.col("p"), lambda s, p: F.greatest(s - p, F.lit(0.0)))

    def smoothed(own: Column, size: Column, prior: Column) -> Column:
        return F.zip_with(own, prior, lambda s, q: (s + PRIOR_PAGES * q) / (size - 1 + PRIOR_PAGES))

    def given_language(column: str) -> Column:
        """log P(value | language), with one page more for each value."""
        return F.zip_with(others(F.col(f"{column}_s")), others(overall), lambda s, t: F.log((s + 1.0) / (t + F.col(f"{column}_n"))))

    out = out.withColumn("prior", F.transform(others(overall), lambda s: (s + 1.0) / (every["pages"] - 1 + n)))
    out = out.withColumn("prior", smoothed(others(F.col("domain_s")), F.col("domain_n"), F.col("prior")))
    out = out.withColumn("prior", smoothed(others(F.col("host_s")), F.col("host_n"), F.col("prior")))
    logs = F.transform("prior", lambda p: F.log(p))
    for part in (F.col("text_logs"), given_language("declared"), given_language("suffix")):
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    out = out.withColumn("logs", logs).withColumn("logs", F.transform("logs", lambda x: F.round(x, 9)))
    best = F.array_max("logs")
    text_logs = F.transform("text_logs", lambda x: F.round(x, 9))
    names = F.array(*map(F.lit, langs))
    return out.select(
        "page_id", "host", "declared", "suffix",
        F.element_at(names, F.array_position(text_logs, F.array_max(text_logs)).cast("int")).alias("text_lang"),
        F.element_at(names, F.array_position("logs", best).cast("int")).alias("lang"),
        F.round(1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - best)), 6).alias("posterior"),
    )


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return identify(pages, spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))
