r"""A Merkle manifest of a dataset: leaves, one subroot a source, one root, a proof a document.

A leaf is the SHA-256 of a row's fields, each with its length before it, so no two rows share
the text that is hashed.  Within a source, leaves ascend by id; every ``fan_out`` consecutive
nodes become the hash of their digests, until one remains: the source's subroot.  Subroots,
in the order of their sources, become the root in the same way.

Bottom-up build.  Leaves are range-sorted by source and id and numbered in two levels (within
a range, and over the ranges' counts), so a source with a third of all rows is as many ranges
as its size asks for.  A level is one grouping by (source, place // fan_out) of the one below;
its groups have ``fan_out`` rows at most.  Each level is written to the shared folder and keeps
the digests of its nodes' children.

Top-down proof push.  From the root down, each level joins its parents; a child puts its run's
other digests before the proof that it inherits.  What a level carries is the proof of its
parents, a ``fan_out``-th of its own, and the last join, at the leaves, is not written at all.
Subroot and root come down with the proofs, so no join has the source alone as its key.

Defined results
    * null fields are ``-``; an empty text is ``0:``; a null source is a source, the first;
    * null ids come first, rows of one id in the order of their leaves; repeated rows are
      leaves of their own, next to each other;
    * a source with one row has that row's leaf as its subroot, and a dataset of one source
      has that source's subroot as its root; a proof may be empty;
    * extra columns are ignored unless they are named; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.llm.storage import drop, stash

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 16
#: Hex digits of a digest.
DIGITS = 64

#: A source as two columns that join and group like values: null is (false, '').
GROUP = ("_named", "_group")
PROOF = "array<struct<at int, siblings string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Digest of the fields: ``-`` for null, else length in bytes, a colon and the value."""

    def told(field: Column) -> Column:
        value = field.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(F.concat(*map(told, fields)))


def _placed(nodes: DataFrame, group: tuple[str, ...], order: list[Column]) -> DataFrame:
    """``nodes`` with ``place`` (from 0, within the group) and ``n``, the group's size."""
    columns = nodes.columns
    keys = [*map(F.col, group), *order]
    rows = stash(nodes.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy(*group, "_range").agg(F.count("*").alias("_rows"))
    own = W.partitionBy(*group)
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*group, "_range", before.alias("_before"), F.sum("_rows").over(own).alias("n"))
    inside = F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)) - 1
    placed = rows.withColumn("_inside", inside).join(counts, [*group, "_range"]).select(*columns, (F.col("_before") + F.col("_inside")).alias("place"), "n")
    out = stash(placed, "leaves")
    drop(rows)
    return out


def _levels(leaves: DataFrame, group: tuple[str, ...], fan_out: int) -> list[DataFrame]:
    """Written levels from ``leaves`` (group, place, n, digest) up; nodes of n = 1 are the roots of their groups."""
    levels, widest = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while widest > 1:
        runs = levels[-1].where("n > 1").groupBy(*group, F.expr(f"place div {fan_out}").alias("place")).agg(F.expr(f"ceil(max(n) / {fan_out})").alias("n"), F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run"))
        level = runs.withColumn("run", F.transform("run", lambda c: c["digest"])).withColumn("digest", digest(F.array_join("run", "")))
        levels.append(stash(level, "level"))
        widest = -(-widest // fan_out)
    return levels


def _proofs(levels: list[DataFrame], group: tuple[str, ...], inherited: DataFrame, fan_out: int) -> DataFrame:
    """The leaves with ``proof`` and what else ``inherited`` (group, proof, ..) has for the root of each group."""
    others = [c for c in inherited.columns if c not in (*group, "proof")]
    above = None
    for k, level in reversed(list(enumerate(levels))):
        nodes = level.where("n = 1").join(inherited, list(group))
        if above is not None:
            at = F.expr(f"int(place % {fan_out})")
            siblings = F.array_join(F.filter("parent_run", lambda _, i: i != at), "")
            parents = above.select(*group, F.col("place").alias("parent"), F.col("run").alias("parent_run"), "proof", *others)
            children = level.where("n > 1").withColumn("parent", F.expr(f"place div {fan_out}")).join(parents, [*group, "parent"])
            pushed = F.concat(F.array(F.struct(at.alias("at"), siblings.alias("siblings"))), F.col("proof")).cast(PROOF)
            nodes = nodes.unionByName(children.withColumn("proof", pushed).drop("parent", "parent_run"))
        above = nodes if k == 0 else stash(nodes, "proofs")
    return above


def prove(leaves: DataFrame, group: str = "source", order: str = "doc_id", fan_out: int = FAN_OUT) -> DataFrame:
    """``leaves`` (group, order, ``leaf`` and any columns more) with subroot, root and proof.

    A proof is an array from the leaf's run up to the root's; each entry has the place of the
    node within its run (``at``) and the digests of the run's others, left to right.
    """
    kept = [c for c in leaves.columns if c not in (group, order, "leaf")]
    rows = leaves.select(F.struct(group, order, *kept).alias("row"), F.col(group).isNotNull().alias(GROUP[0]), F.coalesce(F.col(group), F.lit("")).alias(GROUP[1]), F.col(order).alias("_order"), F.col("leaf").alias("digest"))
    written = stash(rows, "digests")  # texts are hashed once; ranges are sampled from what was written
    placed = _placed(written, GROUP, [F.asc_nulls_first("_order"), F.asc("digest")])
    drop(written)
    levels = _levels(placed, GROUP, fan_out)
    tops = [level.where("n = 1").select(*GROUP, "digest") for level in levels]
    subroots = tops[0]
    for more in tops[1:]:
        subroots = subroots.unionByName(more)
    whole = ("_whole",)
    ordered = _placed(subroots.withColumn("_whole", F.lit(0)), whole, [F.asc(c) for c in GROUP])
    upper = _levels(ordered, whole, fan_out)
    root = upper[-1].select("_whole", F.col("digest").alias("root"), F.array().cast(PROOF).alias("proof"))
    inherited = _proofs(upper, whole, root, fan_out).select(*GROUP, "proof", F.col("digest").alias("subroot"), "root")
    proved = _proofs(levels, GROUP, stash(inherited, "inherited"), fan_out)
    return proved.select("row.*", F.col("digest").alias("leaf"), "subroot", "root", "proof")


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(node: Column, step: Column) -> Column:
        left = step["at"] * DIGITS
        return digest(F.concat(F.substring(step["siblings"], F.lit(1), left), node, F.substring(step["siblings"], left + 1, F.octet_length(step["siblings"]))))

    return F.aggregate(proof, start, up)


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf's level up, left to right."""
    return F.array_join(F.transform(proof, lambda step: step["siblings"]), "")


def manifest(docs: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id", fan_out: int = FAN_OUT) -> DataFrame:
    """Per row of ``docs``: group, order, leaf, subroot, root and proof."""
    return prove(docs.select(group, order, leaf(*map(F.col, fields)).alias("leaf")), group, order, fan_out)


def verify(docs: DataFrame, held: DataFrame, fields=FIELDS, group: str = "source", order: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` against a manifest: group, order, ``state`` and how many rows it is of.

    ``intact``: some leaf of the manifest with that group and id is the row's, and folds to
    the root; ``changed``: there are such leaves, and none is; ``added``: there are none;
    ``missing``: leaves with no row of their group and id.  Leaves are told apart by id, so
    a key with very many rows is compared as distinct leaves.
    """
    key = lambda df: [df[group].isNotNull().alias(GROUP[0]), F.coalesce(df[group], F.lit("")).alias(GROUP[1]), df[order].isNotNull().alias("_known"), F.coalesce(df[order].cast("string"), F.lit("")).alias("_id")]
    names = [*GROUP, "_known", "_id"]
    now = docs.select(*key(docs), leaf(*map(F.col, fields)).alias("leaf")).groupBy(*names, "leaf").agg(F.count("*").alias("rows"))
    then = held.select(*key(held), "leaf", (fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("sound")).groupBy(*names, "leaf").agg(F.min("sound").alias("sound"), F.count("*").alias("leaves"))
    both = now.join(then, [*names, "leaf"], "full")
    there = then.select(*names).distinct().withColumn("_there", F.lit(True))
    here = now.select(*names).distinct().withColumn("_here", F.lit(True))
    both = both.join(there, names, "left").join(here, names, "left")
    state = F.when(F.col("rows").isNotNull() & F.coalesce("sound", F.lit(False)), "intact").when(F.col("rows").isNotNull() & F.col("_there").isNotNull(), "changed").when(F.col("rows").isNotNull(), "added").when(F.col("_here").isNull(), "missing")
    told = both.select(F.when(F.col(GROUP[0]), F.col(GROUP[1])).alias(group), F.when(F.col("_known"), F.col("_id")).cast(docs.schema[order].dataType).alias(order), state.alias("state"), F.coalesce("rows", "leaves").alias("rows"))
    return told.where("state IS NOT NULL").groupBy(group, order, "state").agg(F.sum("rows").alias("rows"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    picked = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    tampered = leaf(*(lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS))
    leaves = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf(*map(F.col, FIELDS)).alias("leaf"), F.when(picked, tampered).alias("tampered"))
    proved = prove(leaves).withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    return proved.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 8) -> str:
    """Levels of both trees as common tables; 16 to the power of ``levels`` leaves at most. A group of one node stays as it is."""
    told = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    text = lambda fields: "sha256(" + " || ".join(map(told, fields)) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i + 1]) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"
    parts = [
        f"rows_ AS MATERIALIZED (SELECT CAST(doc_id AS BIGINT) AS doc_id, source IS NOT NULL AS named, coalesce(source, '') AS grp, {text(FIELDS)} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {text(['doc_id', 'source', 'lang', 'n_chars', f'({low})'])} END AS tampered FROM documents)",
        "s0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY named, grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY named, grp) AS n, leaf AS digest FROM rows_)",
    ]

    def climb(name: str, keys: str) -> None:
        for k in range(levels):
            parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {keys}, place // 16 AS place, CAST(ceil(max(n) / 16.0) AS BIGINT) AS n, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY place)) END AS digest, CASE WHEN max(n) = 1 THEN [] ELSE list(digest ORDER BY place) END AS run FROM {name}{k} GROUP BY {keys}, place // 16)")

    climb("s", "named, grp")
    parts.append(f"t0 AS MATERIALIZED (SELECT named, grp, 0 AS one, row_number() OVER (ORDER BY named, grp) - 1 AS place, count(*) OVER () AS n, digest FROM s{levels})")
    climb("t", "one")
    joins = "".join(f" JOIN s{k} ON s{k}.named = d.named AND s{k}.grp = d.grp AND s{k}.place = d.place // {16 ** k}" for k in range(1, levels + 1))
    joins += " JOIN t0 ON t0.named = d.named AND t0.grp = d.grp" + "".join(f" JOIN t{k} ON t{k}.place = t0.place // {16 ** k}" for k in range(1, levels + 1))
    steps = [(f"{name}{k}.run", f"({base}.place // {16 ** (k - 1)}) % 16") for name, base in (("s", "d"), ("t", "t0")) for k in range(1, levels + 1)]
    chosen = ", ".join(f"{run} AS r{i}, {at} AS a{i}" for i, (run, at) in enumerate(steps))
    parts.append(f"paths AS MATERIALIZED (SELECT d.doc_id, d.leaf, coalesce(d.tampered, d.leaf) AS f0, s{levels}.digest AS subroot, t{levels}.digest AS root, {chosen} FROM s0 d{joins})")
    parts.append("proofs AS (SELECT *, sha256(" + " || ".join(f"array_to_string(list_filter(r{i}, lambda x, j: j <> a{i} + 1), '')" for i in range(len(steps))) + ") AS proof_sha256 FROM paths)")
    last = "proofs"
    for i in range(len(steps)):
        parts.append(f"g{i} AS (SELECT * EXCLUDE (f0), CASE WHEN len(r{i}) = 0 THEN f0 ELSE sha256(array_to_string(list_transform(r{i}, lambda x, j: CASE WHEN j = a{i} + 1 THEN f0 ELSE x END), '')) END AS f0 FROM {last})")
        last = f"g{i}"
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, root, proof_sha256, f0 AS folded_root, f0 = root AS verified FROM {last}"


ORACLE_SQL = {"op11_merkle_manifest": _sql()}
