r"""Hard negatives: for an anchor and each of its nearest rows of the same label, the best rows of other labels just below.

A score is the integer inner product of scaled vectors.  An anchor's positives are its best
``n_positives`` rows of its label; a positive's negatives are the best ``n_negatives`` rows of
other labels with ``low`` % of its score at least and ``high`` % at most.

Rows are dealt to blocks and anchors to groups, by a hash of the row, so neither a label nor a
vector that very many rows share meets in one task; every (block, group) is a cell.  A cell
holds ``BLOCK_VALUES`` components of either side at most.  Rows travel once for each group of
anchors and anchors once for each block, which for N rows and A anchors in blocks of R is
about 2 N A / R rows; all N A scores are worked out, since anchors are a stated query set.

First pass: each cell scores an anchor against the rows of its label and keeps the best.
Second pass: each cell scores an anchor against its block, sorts all scores by score and id
(lexsort), finds the upper limit of each positive by binary search in the sorted scores, and
reads entries of other labels from there down to the lower limit.  Both passes give a few rows
for each anchor and cell, of which a ranking over the cells keeps the first.

Defined results
    * rows with a null label, a null vector or a component that is null or not finite take no part;
    * an id of null comes after all others at a tie; repeated rows are rows: each is an anchor,
      a positive and a negative of its own; a row is never its own positive;
    * vectors of different lengths: what the shorter lacks counts as 0;
    * scores are exact; those beyond 64 bits count as the largest or smallest number of 64 bits;
    * extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.llm.storage import drop, stash

#: Components of one side of a cell at most (32 MB as doubles).
BLOCK_VALUES = 1 << 22
#: Scores worked out at once in a task.
SLAB_SCORES = 1 << 20
MOST = (1 << 63) - 1

BEST = "anchor long, id long, row long, score long"
FOUND = "anchor long, positive_row long, id long, row long, score long"


def scaled(vectors: DataFrame, anchors: Column, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Rows that take part: id, label, anchor (true or false) and components ``c`` as integers."""
    finite = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    part = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).where(finite)
    return part.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("c"),
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix of 64-bit integers, short ones filled with 0."""
    lists = column.combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _largest(matrix: np.ndarray) -> int:
    return max(abs(int(matrix.max())), abs(int(matrix.min()))) if matrix.size else 0


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``: exact, limited to 64 bits."""
    bound = _largest(a) * _largest(b) * max(a.shape[1], 1)
    if bound < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound <= MOST:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -MOST, MOST).astype(np.int64)


def _width(*columns: pa.ChunkedArray) -> int:
    return max((int(np.diff(chunk.offsets.to_numpy()).max(initial=0)) for column in columns for chunk in column.chunks), default=0)


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("nameless", "ascending"), ("id", "ascending"), ("row", "ascending")])


def _slabs(n: int, rows: int):
    step = max(1, SLAB_SCORES // max(rows, 1))
    return ((k, min(k + step, n)) for k in range(0, n, step))


def best_of_label(rows: pa.Table, anchors: pa.Table, n: int) -> pa.Table:
    """The ``n`` best rows of each anchor's label in a cell, without the anchor itself."""
    rows, width = _sorted(rows), _width(rows["c"], anchors["c"])
    b, a = _matrix(rows["c"], width), _matrix(anchors["c"], width)
    ids, own, labels = rows["id"], rows["row"].to_numpy(), rows["label"].to_numpy()
    name, label = anchors["row"].to_numpy(), anchors["label"].to_numpy()
    out_anchor, out_at, out_score = [], [], []
    for value in np.unique(label):
        mine, there = np.flatnonzero(label == value), np.flatnonzero(labels == value)
        for lo, hi in _slabs(len(mine), len(there)):
            for k, scores in zip(mine[lo:hi], _scores(a[mine[lo:hi]], b[there])):
                order = np.lexsort((there, -scores))
                order = order[own[there[order]] != name[k]][:n] if len(order) else order
                out_anchor.append(np.full(len(order), name[k]))
                out_at.append(there[order])
                out_score.append(scores[order])
    at = _join(out_at)
    return pa.table({"anchor": _join(out_anchor), "id": ids.take(pa.array(at)), "row": own[at], "score": _join(out_score)})


def best_of_others(rows: pa.Table, anchors: pa.Table, n: int, low: int, high: int) -> pa.Table:
    """For each positive of each anchor, the ``n`` best rows of other labels in a cell within the limits."""
    rows, width = _sorted(rows), _width(rows["c"], anchors["c"])
    b, a = _matrix(rows["c"], width), _matrix(anchors["c"], width)
    ids, own, labels = rows["id"], rows["row"].to_numpy(), rows["label"].to_numpy()
    name, label, positives = anchors["row"].to_numpy(), anchors["label"].to_numpy(), anchors["positives"].to_pylist()
    place = np.arange(len(own))
    out_anchor, out_positive, out_at, out_score = [], [], [], []
    for lo, hi in _slabs(len(name), len(own)):
        for k, scores in zip(range(lo, hi), _scores(a[lo:hi], b)):
            order = np.lexsort((place, -scores))
            down = -scores[order]  # ascending
            other = np.flatnonzero(labels[order] != label[k])
            for positive in positives[k]:
                p = positive["score"]
                # Largest and smallest score s with 100 s <= high p and low p <= 100 s.
                first = np.searchsorted(down, -_limited(high * p // 100), "left")
                end = np.searchsorted(down, -_limited(-(-low * p // 100)), "right")
                read = other[np.searchsorted(other, first):][:n]
                read = order[read[read < end]]
                out_anchor.append(np.full(len(read), name[k]))
                out_positive.append(np.full(len(read), positive["row"]))
                out_at.append(read)
                out_score.append(scores[read])
    at = _join(out_at)
    return pa.table({"anchor": _join(out_anchor), "positive_row": _join(out_positive), "id": ids.take(pa.array(at)), "row": own[at], "score": _join(out_score)})


def _limited(score: int) -> int:
    return max(-MOST, min(MOST, score))


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, dtype=np.int64)


def hard_negatives(rows: DataFrame, n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from rows of ``scaled``."""
    # The number of a row is written with it, so it stays what it is.
    table = stash(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("nameless", F.col("id").isNull()), "vectors")
    n, n_anchors, width = table.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("c")), F.lit(0))).first()
    size = max(1, block_values // max(width, 1))
    # Blocks of that size at most on average, and one for each core at least.
    blocks = max(-(-n // size), min(table.sparkSession.sparkContext.defaultParallelism, n), 1)
    groups = max(-(-n_anchors // size), 1)
    dealt = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cell = ["block", "group"]
    sides = table.select("id", "nameless", "row", "label", "c", dealt(blocks).alias("block"), every(groups).alias("group"))
    chosen = table.where("anchor")

    def cells(anchors: DataFrame, work, schema: str) -> DataFrame:
        asked = anchors.withColumn("group", dealt(groups)).withColumn("block", every(blocks))
        return sides.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(lambda a, b: work(a, b), schema)

    def first(found: DataFrame, group: list[str], k: int) -> DataFrame:
        order = W.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    best = cells(chosen.select("row", "label", "c"), lambda a, b: best_of_label(a, b, n_positives), BEST)
    positives = first(best, ["anchor"], n_positives).select("anchor", F.struct("id", "row", "score").alias("positive"))
    asked = chosen.select("row", "id", "label", "c").join(positives.groupBy(F.col("anchor").alias("row")).agg(F.collect_list("positive").alias("positives")), "row")
    asked = stash(asked, "anchors")
    found = cells(asked.select("row", "label", "c", F.transform("positives", lambda p: F.struct(p["row"].alias("row"), p["score"].alias("score"))).alias("positives")), lambda a, b: best_of_others(a, b, n_negatives, low, high), FOUND)
    ranked = first(found, ["anchor", "positive_row"], n_negatives)
    names = asked.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), F.explode("positives").alias("p")).select("anchor", "anchor_id", F.col("p.row").alias("positive_row"), F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"))
    return ranked.join(names, ["anchor", "positive_row"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(scaled(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0))


ORACLE_SQL = {
    "op13_hard_negatives": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.r AS anchor, a.id AS anchor_id, b.r, b.id, a.label = b.label AS alike, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.id % 100 = 0),
p AS MATERIALIZED (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, r) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY s.score DESC, s.id, s.r) AS INT) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5""",
}
