"""Quality rules: a threshold table compiled into one projection of built-in functions.

Measures of a text are columns; ``RULES`` is data: a rule keeps a text while
``numerator * 100`` lies between ``least`` and ``most`` per cent of ``denominator``.
``compile_rules`` turns the table into one boolean column per rule.  No user function
and no shuffle is involved: a text is judged by the task that reads it.

Repeated 8-word windows are found by 64-bit hashes, built by doubling (hashes of 1, 2, 4
and 8 words); only texts with a repeated window are sorted to find which words it covers.

Defined results
    * null text: no words, no lines; it fails the base rule;
    * texts of under 8 words have no window;
    * repeated rows are judged alike, each on its own; extra columns are kept by ``judge``;
    * an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"

# Frequent function words of four languages.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "a", "it", "was", "for", "on", "are", "this", "by",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "im", "ein", "ist", "nicht", "des", "auf",
    "le", "la", "les", "des", "et", "un", "une", "du", "en", "est", "que", "pour", "dans", "qui",
    "el", "los", "las", "de", "y", "del", "se", "por", "con", "para", "no", "su", "al", "es",
)

#: (rule, numerator, denominator or None for a plain number, least, most); ratios in per cent.
RULES = (
    ("length", "n_words", None, 20, None),
    ("word_length", "word_chars", "n_words", 200, 1500),
    ("symbol_ratio", "n_symbols", "n_words", None, 20),
    ("stop_words", "n_stop_words", "n_words", 1, None),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 50),
    ("repeated_windows", "n_repeat_words", "n_words", None, 30),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def _pairs(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` further on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame, text_col: str = "text", window: int = 8) -> DataFrame:
    """``docs`` with word_chars, n_words, n_symbols, n_lines, n_dup_lines, n_stop_words and n_repeat_words (long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    long = lambda c: c.cast("long")
    out = docs.withColumn("_words", words_of(F.col(text_col)))
    out = out.withColumn("_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_h1", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_h2", _pairs(F.col("_h1"), 1)).withColumn("_h4", _pairs(F.col("_h2"), 2)).withColumn("_h8", _pairs(F.col("_h4"), 4))
    out = out.withColumn("_same", F.size("_h8") != F.size(F.array_distinct("_h8")))
    # (hash, place) in order; places whose neighbour has the same hash; places in order again.
    out = out.withColumn("_ranked", F.when(F.col("_same"), F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda s, j, step: F.coalesce(F.get(F.col("_ranked"), j + step)["h"] == s["h"], F.lit(False))
    places = F.array_sort(F.transform(F.filter("_ranked", lambda s, j: near(s, j, -1) | near(s, j, 1)), lambda s: s["i"]))
    out = out.withColumn("_places", F.when(F.col("_same"), places))
    gaps = F.zip_with(F.slice("_places", F.lit(1), F.size("_places") - 1), F.slice("_places", F.lit(2), F.size("_places") - 1), lambda a, b: F.least(b - a, F.lit(window)))
    covered = F.aggregate(gaps, F.lit(window), lambda acc, g: acc + g)
    out = out.withColumns({
        "n_words": long(F.size("_words")),
        "word_chars": long(F.length(F.array_join("_words", ""))),
        "n_symbols": long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))),
        "n_lines": long(F.size("_lines")),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_stop_words": long(F.size(F.filter("_words", lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS)))))),
        "n_repeat_words": long(F.when(F.col("_same"), covered).otherwise(0)),
    })
    return out.drop("_words", "_lines", "_h1", "_h2", "_h4", "_h8", "_same", "_ranked", "_places")


def compile_rules(rules=RULES) -> dict[str, Column]:
    """Rule name -> whether a text passes it."""
    out = {}
    for name, numerator, denominator, least, most in rules:
        value, unit = (F.col(numerator), F.lit(1)) if denominator is None else (100 * F.col(numerator), F.col(denominator))
        passes = F.lit(True)
        if least is not None:
            passes = passes & (value >= least * unit)
        if most is not None:
            passes = passes & (value <= most * unit)
        out[name] = passes
    return out


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with its measures, ``base_failed``, the failed rules' names and ``kept``."""
    passes = compile_rules(rules)
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(name)) for name, c in passes.items())))
    out = measures(docs, text_col)
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = out.withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that are kept.

    A plain filter would be pushed below the projections, which copies their nested
    expressions into each other; one on a generator's output stays above them.
    """
    inner = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("text"))
    one = F.explode_outer(F.when(F.col("kept"), F.array(F.lit(True)))).alias("_one")
    return judge(inner, "text", rules).select("_row", one).where("_one").select("_row.*")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

ORACLE_SQL = {
    "op4_quality_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
q AS (SELECT doc_id, i, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM p),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM q WHERE len(g) = 8),
g AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS s FROM h WHERE c > 1),
r AS (SELECT doc_id, sum(s) AS n_repeat_words FROM g GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words
       AND 100 * n_symbols <= 20 * n_words AND 100 * n_stop_words >= n_words
       AND 100 * n_dup_lines <= 50 * n_lines AS kept
FROM b""",
}
