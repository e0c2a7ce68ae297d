"""Parsing of free-form findings and Markdown, and reports rendered by ordered aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.operators.rules import CATEGORIES, SEVERITIES, severity_order

REPLY = "findings array<struct<category string, severity string, rule_id string, title string>>"


# Fills of nodes and styles of edges in Graphviz texts.
DOT_FILL = {
    "controller": "tomato", "service": "lightblue", "repository": "lightgreen", "component": "lightyellow", "configuration": "plum", "bean": "plum", "unknown": "lightgray",
}
DOT_EDGE_STYLE = {"constructor_injection": ("bold", "darkblue"), "field_injection": ("solid", "steelblue"), "import": ("dashed", "gray")}
DOT_HEAD = ("digraph java_dependencies {", '  rankdir="TB";', '  graph [fontname="Helvetica", fontsize=12];', '  node  [shape=box, style=filled, fontname="Helvetica", fontsize=10];', '  edge  [fontname="Helvetica", fontsize=8];', "")


def parse_findings(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Findings in the outermost braces of a free-form reply; items with an unknown category or severity are skipped."""
    body = F.regexp_extract(text_col, r"(?s)\{.*\}", 0)
    items = replies.select(id_col, F.from_json(body, REPLY).alias("r")).select(id_col, F.posexplode("r.findings").alias("pos", "f"))
    item = items.select(
        id_col, "pos", F.lower(F.coalesce("f.category", F.lit("maintainability"))).alias("category"), F.lower(F.coalesce("f.severity", F.lit("info"))).alias("severity"),
        F.coalesce("f.rule_id", F.lit("LLM-000")).alias("rule_id"), F.coalesce("f.title", F.lit("")).alias("title"),
    )
    return item.where(F.col("category").isin(*CATEGORIES) & F.col("severity").isin(*SEVERITIES))


def markdown_section(docs: DataFrame, id_col: str, text_col: str, title: str) -> DataFrame:
    """(id, section): from the first header that holds the title to the next of its level or above."""
    level = F.length(F.regexp_extract("line", r"^(#+)\s", 1))
    rows = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("level", level)
    is_start = (F.col("level") > 0) & F.lower("line").contains(title.lower())
    start = rows.where(is_start).groupBy(id_col).agg(F.min_by(F.struct("pos", "level"), "pos").alias("s"))
    after = rows.join(start, id_col).where(F.col("pos") >= F.col("s.pos"))
    ends = F.sum(F.when((F.col("pos") > F.col("s.pos")) & (F.col("level") > 0) & (F.col("level") <= F.col("s.level")), 1).otherwise(0))
    inside = after.withColumn("ended", ends.over(W.partitionBy(id_col).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))).where("ended = 0")
    return inside.groupBy(id_col).agg(_lines("pos", "line").alias("section"))


def _lines(order: str, line: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(line).alias("_line")))), lambda s: s["_line"]), "\n")


def mermaid(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """One row, diagram: a flow chart with safe node names, edges in order."""
    safe = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")
    line = F.concat(F.lit("    "), safe(src), F.lit(" --> "), safe(dst))
    return edges.select(line.alias("line")).distinct().agg(F.concat(F.lit("graph LR\n"), _lines("line", "line")).alias("diagram"))


def executive_summary(found: DataFrame, score: DataFrame, top: DataFrame) -> DataFrame:
    """One row, summary: totals by severity, the score, and the categories that weigh most."""
    totals = found.agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    worst = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "category"))), lambda s: s["category"]), ", ").alias("worst"))
    text = F.format_string("%d findings (%d critical, %d high, %d medium). Score %.1f (%s). Focus: %s.", "n", "critical", "high", "medium", "score", "grade", "worst")
    return totals.crossJoin(score).crossJoin(worst).select(text.alias("summary"))


def first_snippets(found: DataFrame, chunks: DataFrame, limit: int = 5, classes: int = 2, width: int = 3000, severities: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    """(place, class_name, rule_id, snippet): the texts of the first classes of the gravest findings, each class once, where it first comes.

    found: severity, rule_seq, unit, rule_id and affected_classes; chunks: unit, content, chunk_index.
    """
    head = found.where(F.col("severity").isin(*severities)).orderBy(severity_order(), "rule_seq", "unit").limit(limit)
    order = F.struct(severity_order().alias("s"), "rule_seq", "unit", "k")
    each = head.select("*", F.posexplode(F.slice("affected_classes", 1, classes)).alias("k", "class_name"))
    once = each.groupBy("class_name").agg(F.min(order).alias("first"), F.min_by("rule_id", order).alias("rule_id"))
    text = chunks.join(F.broadcast(once.select(F.col("class_name").alias("unit"))), "unit", "left_semi").groupBy(F.col("unit").alias("class_name")).agg(F.min_by("content", "chunk_index").alias("content"))  # limit * classes rows
    rows = once.join(text, "class_name").where(F.coalesce("content", F.lit("")) != "")
    return rows.select(F.row_number().over(W.orderBy("first")).alias("place"), "class_name", "rule_id", F.substring("content", 1, width).alias("snippet"))


def _lookup(table: dict, key: str, default: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(key)], F.lit(default))


def dot_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, line) of a Graphviz text; written in the order of part and key it is the file, of any size."""
    spark = nodes.sparkSession
    fixed = lambda part, lines: spark.createDataFrame([(part, f"{k:02d}", line) for k, line in enumerate(lines)], "part int, key string, line string")
    label = F.concat("id", F.lit("\\n["), "class_type", F.lit("]"), F.when(F.col("package") != "", F.concat(F.lit("\\n"), "package")).otherwise(""))
    node = F.concat(F.lit('  "'), "id", F.lit('" [label="'), label, F.lit('", fillcolor="'), _lookup(DOT_FILL, "class_type", "lightgray"), F.lit('"];'))
    style = _lookup({k: v[0] for k, v in DOT_EDGE_STYLE.items()}, "dep_type", "dashed")
    color = _lookup({k: v[1] for k, v in DOT_EDGE_STYLE.items()}, "dep_type", "gray")
    edge = F.concat(F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [style="'), style, F.lit('", color="'), color, F.lit('", label="'), "dep_type", F.lit('"];'))
    out = fixed(0, DOT_HEAD).unionByName(nodes.select(F.lit(1).alias("part"), F.col("id").alias("key"), node.alias("line")))
    return out.unionByName(edges.select(F.lit(2).alias("part"), F.concat("src", F.lit(">"), "dst").alias("key"), edge.alias("line"))).unionByName(fixed(3, ["}"]))


def adjacency_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, json): a JSON object for each node and edge, and one of totals: the adjacency document, a row a value."""
    node = F.to_json(F.struct("id", "package", "class_type", "annotations", "file_path"))
    edge = F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "dep_type", "line"))
    totals = nodes.agg(F.count("*").alias("total_classes")).crossJoin(edges.agg(F.count("*").alias("total_dependencies")))
    out = nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("key"), node.alias("json"))
    out = out.unionByName(edges.select(F.lit("edges").alias("part"), F.concat("src", F.lit(">"), "dst").alias("key"), edge.alias("json")))
    return out.unionByName(totals.select(F.lit("stats").alias("part"), F.lit("").alias("key"), F.to_json(F.struct("total_classes", "total_dependencies")).alias("json")))


def node_link_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, key, json): nodes and links with all their attributes, a row a value."""
    node = F.to_json(F.struct("package", "class_type", "annotations", "file_path", "color", "id"))
    link = F.to_json(F.struct("dep_type", "source_file", "line", F.col("src").alias("source"), F.col("dst").alias("target")))
    out = nodes.select(F.lit("nodes").alias("part"), F.col("id").alias("key"), node.alias("json"))
    return out.unionByName(edges.select(F.lit("links").alias("part"), F.concat("src", F.lit(">"), "dst").alias("key"), link.alias("json")))
