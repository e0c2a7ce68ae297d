"""Mixing sources to target weights by weighted fair queueing, on built-in functions.

Every document, in a shuffled order within its source, has a virtual finish time: the
tokens of its source up to and with it, divided by the source's target.  A source whose
target exceeds its size goes round again; no document is taken more than ``max_repeats``
times.  All turns of all documents are range-sorted by finish time over the whole corpus
and cut where their running sum of tokens reaches the budget, so each source gets its share
at any cut.  What is given is then told from the key of the last turn that was: no join.

The order is the MD5 of id and text, so reruns agree and SQL can say it.  Both orders are
range-partitioned by their full key (Spark samples the ranges, so a source with a third of
all rows spans as many as its size asks for) and summed in two levels: within a range, and
over the ranges' totals, of which there is one a partition (and source).  Repeated rows are
one entry with a count until the end, so they are no hot range.

Defined results
    * null text: size 0, never taken; a null source is a source, the last in order;
    * sources without words have target 0;
    * repeated rows are documents of their own, taken one after another;
    * ties of finish time go by source, then by the shuffled order, then by turn;
    * extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.llm.quality import words_of
from lithograph.llm.storage import drop, stash

WEIGHTS = (3.0, 1.0, 2.0)


def source_key(source: str = "source") -> list[Column]:
    """Order of sources: by code point, null last."""
    return [F.col(source).isNull().alias("_null"), F.coalesce(source, F.lit("")).alias("_source")]


def range_sorted(df: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """``df`` written in the order of ``keys``, with the number of its range as ``_range``."""
    return stash(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_range", F.spark_partition_id()), name)


def running_sum(df: DataFrame, keys: list[Column], amount: str, name: str, group: str) -> DataFrame:
    """Rows of ``range_sorted`` with the sum of ``amount`` over the earlier rows of the same group (null is a group)."""
    totals = df.groupBy(group, "_range").agg(F.sum(amount).alias("_total"))
    earlier = W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    within = W.partitionBy(group, "_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = inner.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_before", "_within", "_g", "_r", "_range")


def targets(sources: DataFrame, weights=WEIGHTS, budget_ratio: float = 1.5, max_repeats: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources over their cap are fixed at it and the rest is shared anew by weight until
    no target exceeds its cap: a few sums over the table of sources, one row each.
    """
    ordered = range_sorted(sources.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)), source_key(), "sources")
    k = running_sum(ordered, source_key(), "_one", "_k", "_all")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % len(weights) + 1).cast("int"))
    table = stash(k.withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size")).select("source", "source_size", "weight", "cap"), "weights")
    drop(ordered)
    size, = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()
    budget, level = budget_ratio * size, 0.0
    while True:
        full = F.col("cap") <= level * F.col("weight")
        fixed, rest = table.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        raised = (budget - fixed) / rest if rest else math.inf
        if raised <= level or not rest:
            level = max(level, raised)
            break
        level = raised
    share = F.lit(level) * F.col("weight") if math.isfinite(level) else F.lit(math.inf)
    return table.select("source", "source_size", F.least("cap", share).alias("target"))


def _last_given(entries: DataFrame, order: list[Column], budget: int) -> Column | bool:
    """The key (a struct) of the last entry, in order, up to which sizes stay within the budget; or whether all or none do."""
    sorted_ = range_sorted(entries, order, "turns")
    # One number a partition.
    totals = sorted(tuple(r) for r in sorted_.groupBy("_range").agg(F.sum("size")).collect())
    used, cut = 0, None
    for number, total in totals:
        if used + total > budget:
            cut = number
            break
        used += total
    if cut is None:
        drop(sorted_)
        return True
    key = F.struct(*order)
    within = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = sorted_.where(F.col("_range") == cut).withColumn("_upto", F.lit(used) + F.sum("size").over(within))
    last = inside.where(F.col("_upto") <= budget).agg(F.max(key)).first()[0]
    if last is None:  # the cut is between two ranges
        last = sorted_.where(F.col("_range") < cut).agg(F.max(key)).first()[0]
    kinds = sorted_.select(*order).schema
    drop(sorted_)
    return last is not None and F.struct(*(F.lit(bytes(x) if isinstance(x, bytearray) else x).cast(f.dataType).alias(f.name) for x, f in zip(last, kinds)))


def mix(docs: DataFrame, weights=WEIGHTS, budget_ratio: float = 1.5, max_repeats: int = 2, seed: int = 42) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies and ``taken`` (words)."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.size(words_of(F.col("text"))).cast("long").alias("size"),
        F.unhex(F.md5(name)).alias("shuffle"),
    )
    sized = sized.groupBy("doc_id", "source", "size", "shuffle").agg(F.count("*").alias("rows")).withColumn("words", F.col("size") * F.col("rows"))
    place = [*source_key(), F.col("shuffle"), F.col("doc_id").isNull().alias("_no_id"), F.col("doc_id")]
    sized = range_sorted(sized, place, "sizes")
    plan = stash(targets(sized.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_ratio, max_repeats), "targets")
    # Whole words; sums of fractions may fall a trifle short.
    budget = math.floor(plan.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] + 1e-3)

    queued = running_sum(sized, place, "words", "before", "source")
    queued = queued.join(plan.withColumnRenamed("source", "_source_name"), F.col("source").eqNullSafe(F.col("_source_name"))).drop("_source_name")
    queued = stash(queued.drop("words"), "queue")
    drop(sized)
    each = queued.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))

    # A turn in which a source may give the document; finish times reach 1 at the source's target.
    def finish(turn) -> Column:
        return (F.col("before") + F.col("copy") * F.col("size") + turn * F.col("source_size")) / F.col("target")

    can = (F.col("size") > 0) & (F.col("target") > 0)
    turns = each.where(can).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("finish", finish(F.col("turn")))
    order = lambda finish, turn: [finish.alias("finish"), *source_key(), F.col("shuffle"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_id"), F.col("copy"), turn.alias("turn")]
    last = _last_given(turns.select("finish", "source", "shuffle", "doc_id", "copy", "turn", "size"), order(F.col("finish"), F.col("turn")), budget)
    copies = F.lit(0)
    for turn in range(max_repeats):
        given = F.lit(last) if isinstance(last, bool) else F.struct(*order(finish(F.lit(turn)), F.lit(turn))) <= last
        copies = copies + F.when(can & given, 1).otherwise(0)
    out = each.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op8_weighted_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


# The level up to which sources are filled is the least that its own shares give back.
MIX_SQL = r"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('42:' || coalesce(CAST(CAST(doc_id AS BIGINT) AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * CAST(sum(size) AS DOUBLE) AS cap FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight FROM s),
b AS (SELECT 1.5 * CAST(sum(source_size) AS DOUBLE) AS budget FROM w),
tried AS (SELECT (budget - coalesce((SELECT sum(cap) FROM w WHERE w.cap / w.weight < r), 0)) / (SELECT sum(weight) FROM w WHERE w.cap / w.weight >= r) AS level FROM (SELECT DISTINCT cap / weight AS r FROM w), b),
held AS (SELECT level, (SELECT budget FROM b) AS budget, coalesce(sum(cap) FILTER (WHERE cap <= level * weight), 0) AS fixed, sum(weight) FILTER (WHERE cap > level * weight) AS rest FROM tried, w GROUP BY level),
filled AS (SELECT min(level) AS level FROM held WHERE (budget - fixed) / rest <= level),
t AS (SELECT source, source_size, least(cap, (SELECT level FROM filled) * weight) AS target FROM w),
q AS (SELECT d.*, source_size, target, CAST(sum(size) OVER g AS BIGINT) AS upto, row_number() OVER g AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  WINDOW g AS (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
e AS (SELECT source, k, size, turn, h, doc_id, CAST(upto + turn * source_size AS DOUBLE) / target AS finish FROM q, (VALUES (0), (1)) v(turn) WHERE size > 0 AND target > 0),
o AS (SELECT source, k, size, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, k, turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM e),
c AS (SELECT source, k, CAST(sum(size) AS BIGINT) AS taken FROM o WHERE used <= (SELECT floor(sum(target) + 0.001) FROM t) GROUP BY source, k)
SELECT doc_id, q.source, size, source_size, target, CAST(CASE WHEN size > 0 THEN coalesce(taken, 0) // size ELSE 0 END AS BIGINT) AS copies, coalesce(taken, 0) AS taken
FROM q LEFT JOIN c ON q.source IS NOT DISTINCT FROM c.source AND q.k = c.k"""

ORACLE_SQL = {"op8_weighted_mix": f"SELECT doc_id, size, source_size, target, taken FROM ({MIX_SQL})"}
