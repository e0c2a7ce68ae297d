"""Named questions to a dependency graph, and their answers as ordered lines.

nodes: id, package, class_type; edges: src, dst, dep_type, line.  An answer is a table
(key, line); in the order of its keys it is the text.  ``ask`` finds a question by name;
``route`` sends a free question to those that its words name, and ``fan_out`` runs several.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.functions.storage import cut
from lithograph.operators import graph as G


def related(nodes: DataFrame, edges: DataFrame, name: str, *, inward: bool) -> DataFrame:
    """(class, package, class_type, relationship, dep_type) of all that depend on a class (inward), or that it depends on."""
    found = G.closure(G.reversed_edges(edges) if inward else edges.select("src", "dst"), name)
    near, far = ("src", "dst") if inward else ("dst", "src")
    direct = edges.where(F.col(far) == name).select(F.col(near).alias("id"), "dep_type")
    rows = found.join(nodes.select("id", "package", "class_type"), "id").join(direct, "id", "left")
    kind = F.when(F.col("relationship") == "direct", F.col("dep_type")).otherwise("transitive")
    return rows.select(F.col("id").alias("class"), "package", "class_type", "relationship", kind.alias("dep_type"))


def chain(nodes: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(step, class, package, class_type, dep_type, next): the shortest path as rows; dep_type and next are null at its end."""
    path = cut(G.shortest_path(edges, source, target))
    steps = path.select(F.posexplode("path").alias("step", "class")).join(nodes.select(F.col("id").alias("class"), "package", "class_type"), "class")
    onward = G.path_steps(path, edges.select("src", "dst", "dep_type")).select("step", "dep_type", F.col("dst").alias("next"))
    return steps.join(onward, "step", "left").select("step", "class", "package", "class_type", "dep_type", "next")


def report(nodes: DataFrame, edges: DataFrame, ranks: DataFrame, max_cycle: int | None = None) -> dict[str, DataFrame]:
    """All structural findings at once, each a table."""
    metrics = G.degrees(nodes, edges)
    return {
        "circular_dependencies": G.cycles(edges.select("src", "dst"), max_cycle),
        "orphan_classes": G.orphans(nodes, edges),
        "highly_coupled": metrics.where("highly_coupled"),
        "layer_violations": G.layer_violations(edges.select("src", "dst"), ranks),
        "coupling_metrics": metrics,
    }


def report_lines(found: dict[str, DataFrame]) -> DataFrame:
    """(key, line): totals of a report, then its highly coupled classes, most coupled first, orphans and violations."""
    counts = [found[name].agg(F.count("*").alias("n")).select(F.lit(f"0{k}").alias("key"), F.format_string("  %-21s: %d", F.lit(title), "n").alias("line"))
              for k, (name, title) in enumerate((("coupling_metrics", "Classes analysed"), ("circular_dependencies", "Circular deps"), ("orphan_classes", "Orphan classes"), ("highly_coupled", "Highly coupled"), ("layer_violations", "Layer violations")))]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    total = F.col("ca") + F.col("ce")
    coupled = found["highly_coupled"].select(F.format_string("1-%010d-%s", F.lit(10**9) - total, "id").alias("key"), F.format_string("    %-35s Ca=%d  Ce=%d  I=%.2f", "id", "ca", "ce", "instability").alias("line"))
    alone = found["orphan_classes"].select(F.concat(F.lit("2-"), "id").alias("key"), F.concat(F.lit("    "), "id").alias("line"))
    wrong = found["layer_violations"].select(F.concat(F.lit("3-"), "src", F.lit(">"), "dst").alias("key"), F.concat(F.lit("    "), "src", F.lit(" -> "), "dst").alias("line"))
    return out.unionByName(coupled).unionByName(alone).unionByName(wrong)


def _listed(rows: DataFrame, key, line) -> DataFrame:
    return rows.select(key.alias("key"), line.alias("line"))


def _related_lines(nodes, edges, name, *, inward: bool) -> DataFrame:
    tail = F.format_string("[%s, %s]", "relationship", "dep_type") if inward else F.format_string("[%s]", "relationship")
    return _listed(related(nodes, edges, name, inward=inward), F.concat("relationship", F.lit("-"), "class"), F.concat(F.lit("  - "), "class", F.lit(" ("), "class_type", F.lit(") "), tail))


def _chain_line(nodes, edges, source, target) -> DataFrame:
    steps = chain(nodes, edges, source, target)
    text = F.concat("class", F.lit(" ("), "class_type", F.lit(")"), F.coalesce(F.concat(F.lit(" --["), "dep_type", F.lit("]--> ")), F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", text.alias("t")))), lambda s: s["t"]), "")
    return steps.agg(joined.alias("line")).where("line <> ''").select(F.lit("0").alias("key"), "line")


def _top(nodes, edges, n: int = 10) -> DataFrame:
    top = G.top_by_degree(nodes, edges, "dst", n).where("degree > 0").join(nodes.select("id", "class_type"), "id")
    return _listed(top, F.format_string("%010d-%s", F.lit(10**9) - F.col("degree"), "id"), F.format_string("  - %s (%s): %d dependent(s)", "id", "class_type", "degree"))


def _stats(nodes, edges) -> DataFrame:
    row = G.stats(nodes, edges.select("src", "dst"))
    pairs = (("total_classes", "n_nodes"), ("total_dependencies", "n_edges"), ("is_dag", "is_dag"), ("weakly_connected_components", "n_components"), ("density", "density"))
    return row.select(F.inline(F.array(*(F.struct(F.lit(str(k)).alias("key"), F.concat(F.lit(f"{name}: "), F.col(c).cast("string")).alias("line")) for k, (name, c) in enumerate(pairs)))))


def _cycle_lines(edges) -> DataFrame:
    found = G.cycles(edges.select("src", "dst"))
    return _listed(found, F.format_string("%04d-%s", "length", F.array_join("path", ">")), F.concat(F.lit("  - "), F.array_join("path", " -> "), F.lit(" -> "), F.get("path", F.lit(0))))


#: Question -> answer from (nodes, edges, class_name, source_class, target_class).
QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    "who_depends_on": lambda n, e, name, s, t: _related_lines(n, e, name, inward=True),
    "get_dependencies": lambda n, e, name, s, t: _related_lines(n, e, name, inward=False),
    "dependency_chain": lambda n, e, name, s, t: _chain_line(n, e, s, t),
    "cycles": lambda n, e, name, s, t: _cycle_lines(e),
    "most_depended_on": lambda n, e, name, s, t: _top(n, e),
    "orphans": lambda n, e, name, s, t: _listed(G.orphans(n, e), F.col("id"), F.concat(F.lit("  - "), "id")),
    "stats": lambda n, e, name, s, t: _stats(n, e),
    "by_type": lambda n, e, name, s, t: _listed(n.where(F.col("class_type") == name), F.col("id"), F.concat(F.lit("  - "), "id")),
}


def ask(nodes: DataFrame, edges: DataFrame, question: str, class_name: str = "", source: str = "", target: str = "") -> DataFrame:
    """The answer to a named question; one line says so if the name is unknown."""
    if question not in QUESTIONS:
        return nodes.sparkSession.createDataFrame([("0", f"Unknown query_type: {question}. Choose from: {', '.join(QUESTIONS)}")], "key string, line string")
    return QUESTIONS[question](nodes, edges, class_name, source, target)


# Rounds and characters.
#: Specialists and the words that call them; rounds after which a conversation ends, and characters of an answer that are kept.
SPECIALISTS = {
    "search": ("how does", "show", "source", "method", "explain"), "architecture": ("layer", "module", "architecture", "spring", "structure"),
    "dependency": ("depend", "cycle", "circular", "chain", "coupl"), "docs": ("onboard", "document", "getting started", "guide"),
    "review": ("review", "security", "solid", "debt", "duplicate", "performance", "quality"),
}
MAX_ROUNDS = 8
ANSWER_CHARS = 1500


def route(questions: DataFrame, text: str = "question", rounds: str | None = None) -> DataFrame:
    """``questions`` with ``agents`` (those that its words call, in order) and ``next``: one, parallel or synthesize."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    called = F.array_compact(F.array(*(F.when(F.greatest(*(low.contains(w) for w in words)), F.lit(name)) for name, words in SPECIALISTS.items())))
    spent = F.lit(False) if rounds is None else F.col(rounds) >= MAX_ROUNDS
    agents = F.when(spent, F.slice(called, 1, 0)).otherwise(called)
    step = F.when(F.size("agents") == 0, "synthesize").when(F.size("agents") == 1, "one").otherwise("parallel")
    return questions.withColumn("agents", agents).withColumn("next", step)


#: What a coordinator says when nothing more shall be asked.
FINISH = "FINISH"


def named_route(rows: DataFrame, names: str = "next_agents", rounds: str | None = None) -> DataFrame:
    """``rows`` with ``agents`` (the specialists among the names that a coordinator gave, in its order, each once) and ``next``.

    Names that are no specialist's are dropped; without any that is, after FINISH, or when the rounds are spent, answers are put together.
    """
    known = F.array_distinct(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n.isin(*SPECIALISTS)))
    done = F.coalesce(F.array_contains(names, FINISH), F.lit(False))
    if rounds is not None:
        done = done | (F.col(rounds) >= MAX_ROUNDS)
    agents = F.when(done, F.slice(known, 1, 0)).otherwise(known)
    step = F.when(F.size("agents") == 0, "synthesize").when(F.size("agents") == 1, "one").otherwise("parallel")
    return rows.withColumn("agents", agents).withColumn("next", step)


def synthesis(question: str, results: DataFrame) -> DataFrame:
    """(part, agent, key, line) of what the last step is given: the question, then each agent's answer under its name; one line where there is none."""
    spark = results.sparkSession
    fixed = lambda part, *texts: [(part, "", f"{k:03d}", t) for k, t in enumerate(texts)]
    rows = lambda lines: spark.createDataFrame(lines, "part int, agent string, key string, line string")
    if results.isEmpty():
        return rows(fixed(0, "No information was gathered. Please try a more specific question."))
    own = results.select("agent").distinct().select(F.lit(1).alias("part"), "agent", F.lit("").alias("key"), F.concat(F.lit("--- "), F.upper("agent"), F.lit(" AGENT ---")).alias("line"))
    said = results.select(F.lit(1).alias("part"), "agent", F.concat(F.lit("-"), "key").alias("key"), "line")
    return rows(fixed(0, f"Question: {question}", "", "Specialist Agent Results:") + fixed(2, "", "Synthesize a complete, grounded answer:")).unionByName(own).unionByName(said)


def fan_out(answers: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(agent, key, line) of independent answers, worked out at the same time and cut to ANSWER_CHARS a line."""
    with ThreadPoolExecutor(max(1, len(answers))) as pool:
        ready = dict(zip(answers, pool.map(lambda make: cut(make()), answers.values())))
    out = None
    for name, rows in ready.items():
        part = rows.select(F.lit(name).alias("agent"), "key", F.substring("line", 1, ANSWER_CHARS).alias("line"))
        out = part if out is None else out.unionByName(part)
    return out
