"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept.
All but the last return the columns of ``documents``:

* quality: documents that a rule rejects go;
* near_duplicates: of each group of linked documents the one with the smallest id stays;
  documents without words are linked with nothing and stay;
* repeated_passages: words in windows of 35 that occur elsewhere go, and with them the line
  breaks of the documents they were in; other documents stay as they are;
* benchmark_leaks: documents in which a benchmark window occurs go;
* mix: one row per document with what the mix takes of it.

Rows with null ids or texts, repeated rows and empty tables pass through by the rules that
the operators state.  Where rows of one document differ in other columns only, the one with
the least hash of all its columns stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.llm import chunks, decontaminate, jaccard, mixing, quality, substring
from lithograph.llm.storage import drop, stash


def _over(sql: str, table: str) -> str:
    return sql.replace("FROM documents", f"FROM {table}")


#: The stages as SQL, each over the one before; ids are unique.
ORACLE_SQL = f"""WITH good AS MATERIALIZED (SELECT documents.* FROM documents JOIN ({quality.ORACLE_SQL["op4_quality_rules"]}) j USING (doc_id) WHERE kept),
single AS MATERIALIZED (SELECT good.* FROM good JOIN ({_over(jaccard.ORACLE_SQL["op3_ngram_jaccard_join"], "good")}) j USING (doc_id) WHERE n_shingles = 0 OR component_id = doc_id),
cut AS MATERIALIZED (SELECT doc_id, CASE WHEN n_removed > 0 THEN kept_text ELSE text END AS text, lang, source, CASE WHEN n_removed > 0 THEN length(kept_text) ELSE n_chars END AS n_chars FROM ({_over(substring.KEPT_SQL, "single")})),
clean AS MATERIALIZED (SELECT cut.* FROM cut JOIN ({_over(decontaminate.ORACLE_SQL["op9_benchmark_decontamination"], "cut")}) j USING (doc_id) WHERE NOT contaminated)
SELECT * FROM ({_over(mixing.MIX_SQL, "clean")})"""


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps, with all their columns."""
    return quality.keep(docs)


def _rows(docs: DataFrame) -> DataFrame:
    """Whole rows beside their text's key, so that no column of theirs meets one of ours."""
    return docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), chunks.text_sha().alias("sha"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; documents without words."""
    texts = jaccard.jaccard_components(docs)
    blank = F.col("n_shingles") == 0
    keep = texts.where(blank | F.col("representative")).select("sha", "min_id", blank.alias("blank"))
    rows = _rows(docs).join(keep, "sha")
    first = rows.where(~F.col("blank") & F.col("id").eqNullSafe(F.col("min_id"))).groupBy("sha").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return first.select("row").unionByName(rows.where("blank").select("row")).select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words in windows of 35 that occur elsewhere too."""
    cut = substring.substring_dedup(docs).where("n_removed > 0").select("sha", "kept")
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    own = lambda c: F.col("row")[c]
    columns = [(F.when(F.col("kept").isNotNull(), new[c]).otherwise(own(c)) if c in new else own(c)).alias(c) for c in docs.columns]
    return _rows(docs).join(cut, "sha", "left").select(*columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    hit = decontaminate.contaminated_texts(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("sha")
    return _rows(docs).join(hit, "sha", "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document: its source, size and target, and what the mix takes of it."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("mix", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
        if held is not None:
            drop(held)
        held = docs
    return docs
