"""Dependency-graph analytics over edges (src, dst) and nodes (id).

Nodes and edges are tables.  One-step questions are joins and grouped counts; reachability
and components are frontier loops whose rounds are cut by checkpoints.  Simple paths and
cycles carry their path, and grow only where a backward search says that they can still end:
paths within their cutoff, cycles inside a strong component.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.functions.storage import cut


def build_edges(raw: DataFrame, nodes: DataFrame, priority: dict[str, int] | None = None) -> DataFrame:
    """Internal edges only, no self loops; of parallel edges the strongest kind wins, then the first.

    raw: src, dst[, dep_type, line, seq]; nodes: id.
    """
    inner = raw.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").where("src <> dst")
    if not priority:
        return inner.select("src", "dst").distinct()
    rank = F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))
    best = F.max_by(F.struct("dep_type", "line"), F.struct(F.coalesce(rank[F.col("dep_type")], F.lit(0)), -F.col("seq")))
    return inner.groupBy("src", "dst").agg(best.alias("b")).select("src", "dst", "b.dep_type", "b.line")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, afferent and efferent coupling, instability (rounded to 3) and total > 4."""
    ca = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("ca"))
    ce = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("ce"))
    out = nodes.select("id").join(ca, "id", "left").join(ce, "id", "left").na.fill(0, ["ca", "ce"])
    total = F.col("ca") + F.col("ce")
    out = out.withColumn("instability", F.round(F.coalesce(F.try_divide(F.col("ce"), total), F.lit(0.0)), 3))
    return out.withColumn("highly_coupled", total > 4)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.select("id").join(ends, "id", "left_anti")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth): everything reachable from each root (column id of ``starts``), the root itself left out."""
    seen = cut(starts.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("id") == F.col("src")).select("root", F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen.select("root", "id"), ["root", "id"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen.where("depth > 0")


def closure(edges: DataFrame, node) -> DataFrame:
    """id, relationship of everything that ``node`` reaches: direct or transitive."""
    spark = edges.sparkSession
    start = spark.createDataFrame([(node,)], ["id"]).select(F.col("id").cast(dict(edges.dtypes)["src"]).alias("id"))
    found = reachable(edges, start)
    return found.select("id", F.when(F.col("depth") == 1, "direct").otherwise("transitive").alias("relationship"))


def distances(edges: DataFrame, targets: DataFrame, max_depth: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """(target, id, distance): fewest edges from each node to each target (column id of ``targets``), the target itself at 0.

    ``within`` (target, id) says through which nodes a search may go; without it, through all.
    """
    seen = cut(targets.select(F.col("id").alias("target"), "id", F.lit(0).alias("distance")))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, F.col("id") == F.col("dst")).select("target", F.col("src").alias("id")).distinct()
        if within is not None:
            step = step.join(within, ["target", "id"], "left_semi")
        frontier = cut(step.join(seen.select("target", "id"), ["target", "id"], "left_anti").withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def path_rounds(edges: DataFrame, source, target, cutoff: int) -> Iterator[tuple[int, DataFrame]]:
    """(length, paths of that length from source that can still reach target), path by array, ``at`` its end.

    One backward search tells how far each node is from the target; a path goes on only to
    nodes that are near enough for what is left of ``cutoff``.
    """
    kind = dict(edges.dtypes)["src"]
    edges = edges.select("src", "dst").distinct()
    at = edges.sparkSession.createDataFrame([(target,)], ["id"]).select(F.col("id").cast(kind).alias("id"))
    far = cut(distances(edges, at, cutoff).select(F.col("id").alias("dst"), "distance"))
    near = edges.join(far, "dst")
    paths = near.where((F.col("src") == source) & (F.col("dst") != source) & (F.col("distance") < cutoff)).select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    for length in range(1, cutoff + 1):
        paths = cut(paths)
        yield length, paths
        if length == cutoff or paths.isEmpty():
            return
        onward = paths.where(F.col("at") != target).join(near, F.col("at") == F.col("src")).where((F.col("distance") + length + 1 <= cutoff) & ~F.array_contains("path", F.col("dst")))
        paths = onward.select(F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))


def simple_paths(edges: DataFrame, source, target, cutoff: int) -> DataFrame:
    """(path, length) of every simple path from source to target of at most ``cutoff`` edges; none from a node to itself."""
    done = None
    for length, paths in path_rounds(edges, source, target, cutoff):
        hit = paths.where(F.col("at") == target).select("path", F.lit(length).alias("length"))
        done = hit if done is None else done.unionByName(hit)
    return done


def shortest_path(edges: DataFrame, source, target, cutoff: int | None = None) -> DataFrame:
    """(path, length) of the shortest path; of equally short ones the first in the order of its nodes.

    Breadth first: every node is reached once, with the least path to it, so work follows nodes and edges.
    """
    kind = dict(edges.dtypes)["src"]
    start = edges.sparkSession.createDataFrame([(source,)], ["id"]).select(F.col("id").cast(kind).alias("id"))
    frontier = cut(start.select("id", F.array("id").alias("path")))
    seen, depth = frontier.select("id"), 0
    while cutoff is None or depth < cutoff:
        depth += 1
        step = frontier.join(edges.select("src", "dst"), F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.array_append("path", F.col("dst")).alias("path"))
        frontier = cut(step.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        hit = frontier.where(F.col("id") == target).select("path", F.lit(depth).alias("length"))
        if not hit.isEmpty() or frontier.isEmpty():
            return hit
        seen = cut(seen.unionByName(frontier.select("id")))
    return frontier.limit(0).select("path", F.lit(depth).alias("length"))


def path_steps(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, step, src, dst) for consecutive nodes of each path."""
    step = F.posexplode(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda x, i: F.struct(x.alias("src"), F.element_at("path", i + 2).alias("dst"))))
    return paths.select("path", step.alias("step", "e")).select("path", "step", "e.src", "e.dst").join(edges, ["src", "dst"])


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that lead on and are led to, round by round: what is left holds every cycle."""
    rest, count = edges, edges.count()
    while count:
        entered, left = rest.select(F.col("dst").alias("src")).distinct(), rest.select(F.col("src").alias("dst")).distinct()
        rest = cut(rest.join(entered, "src", "left_semi").join(left, "dst", "left_semi").select("src", "dst"))
        before, count = count, rest.count()
        if count == before:
            break
    return rest


def _first_sources(edges: DataFrame) -> DataFrame:
    """(id, colour): the least node from which each node is reached, itself included.

    What reaches a node's colour reaches the node, so colours follow their own colours as well as edges.
    """
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    colours = cut(ends.select("id", F.col("id").alias("colour")))
    while True:
        offered = edges.join(colours, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("offer"))
        lower = colours.join(offered, "id", "left").select("id", F.col("colour").alias("was"), F.least("colour", "offer").alias("colour"))
        further = colours.select(F.col("id").alias("colour"), F.col("colour").alias("further"))
        after = cut(lower.join(further, "colour", "left").select("id", "was", F.least("colour", "further").alias("colour")))
        colours = after.select("id", "colour")
        if after.where("colour <> was").isEmpty():
            return colours


#: A search around one node goes on while it grows as in a large component: so many nodes after so many rounds, and no more rounds than these.
GROWN_AFTER, GROWN_NODES, AROUND_ROUNDS = 6, 64, 64


def _around(edges: DataFrame) -> DataFrame | None:
    """(id, fore, back): which nodes the best connected node reaches, and which reach it; None where the search does not spread."""
    out, into = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_out")), edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n_in"))
    best = out.join(into, "id").orderBy(F.desc(F.col("n_out") * F.col("n_in")), "id").select("id").first()
    if best is None:
        return None
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    here = F.col("id") == F.lit(best.id)
    state = cut(ends.select("id", here.alias("fore"), here.alias("back"), here.alias("new_fore"), here.alias("new_back")))
    for depth in range(1, AROUND_ROUNDS + 1):
        on = edges.join(state.where("new_fore").select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id"), F.lit(True).alias("f"), F.lit(False).alias("b"))
        off = edges.join(state.where("new_back").select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), F.lit(False).alias("f"), F.lit(True).alias("b"))
        met = on.unionByName(off).groupBy("id").agg(F.max("f").alias("f"), F.max("b").alias("b"))
        joined = state.join(met, "id", "left").na.fill(False, ["f", "b"])
        state = cut(joined.select("id", (F.col("fore") | F.col("f")).alias("fore"), (F.col("back") | F.col("b")).alias("back"), (F.col("f") & ~F.col("fore")).alias("new_fore"), (F.col("b") & ~F.col("back")).alias("new_back")))
        if state.where("new_fore OR new_back").isEmpty():
            return state.select("id", "fore", "back")
        if depth == GROWN_AFTER and state.where("fore OR back").count() < GROWN_NODES:
            return None
    return None


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node that a node reaches and is reached from (itself, if there is no other).

    If a search from the best connected node spreads, what it reaches and is reached from is a
    component of its own, and no other goes from what it reaches to what it does not, or from what
    reaches it to what does not: a large component goes first, and few edges stay.
    Nodes on no cycle are then trimmed.  A forward search gives each node the least node that
    reaches it, its colour; a backward search inside each colour, from the node that is its
    own colour, finds that node's component.  All colours are searched at once; what was not
    found goes another round.
    """
    rest, done = cut(edges.where("src <> dst").select("src", "dst").distinct()), None
    state = _around(rest)
    if state is not None:
        large = state.where("fore AND back").select("id")
        done = cut(large.crossJoin(F.broadcast(large.agg(F.min("id").alias("colour")))))
        side = F.struct("fore", "back")
        left = rest.join(state.select(F.col("id").alias("src"), side.alias("at")), "src").join(state.select(F.col("id").alias("dst"), side.alias("to")), "dst")
        rest = cut(left.where("at = to AND NOT (at.fore AND at.back)").select("src", "dst"))
    while True:
        rest = _trimmed(rest)
        if rest.isEmpty():
            break
        colours = _first_sources(rest)
        own = rest.join(colours.select(F.col("id").alias("src"), "colour"), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("to_colour")), "dst").where("colour = to_colour")
        own = cut(own.select("src", "dst"))
        found = cut(colours.where("id = colour"))
        frontier = found
        while True:
            step = frontier.join(own, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "colour").distinct()
            frontier = cut(step.join(found, ["id"], "left_anti"))
            if frontier.isEmpty():
                break
            found = cut(found.unionByName(frontier).repartition("id"))
        done = found if done is None else done.unionByName(found)
        gone = found.select("id")
        rest = cut(rest.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return nodes.select("id", F.col("id").alias("component"))
    return nodes.select("id").join(done, "id", "left").select("id", F.coalesce("colour", "id").alias("component"))


def cycle_rounds(edges: DataFrame, max_length: int | None = None) -> Iterator[tuple[int, DataFrame]]:
    """(length, open paths of that length from a root), each of which can come back to its root within ``max_length``.

    A cycle lies within one strong component and starts at its smallest node, so a path keeps
    to its component and to nodes above its root, and goes on only to nodes from which a
    backward search of the root has come.  Columns: root, path, at.
    """
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    parts = strong_components(ends, edges)
    inner = edges.join(parts.select(F.col("id").alias("src"), "component"), "src").join(parts.select(F.col("id").alias("dst"), F.col("component").alias("to")), "dst").where("component = to")
    inner = cut(inner.select("src", "dst"))
    roots = inner.where("src < dst").select(F.col("src").alias("id")).distinct()
    # Backward from every root at once, through nodes above it.
    back = cut(roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("distance")))
    frontier, depth = back, 0
    while max_length is None or depth < max_length - 1:
        depth += 1
        step = frontier.join(inner, F.col("id") == F.col("dst")).where("src > root").select("root", F.col("src").alias("id")).distinct()
        frontier = cut(step.join(back, ["root", "id"], "left_anti").withColumn("distance", F.lit(depth)))
        if frontier.isEmpty():
            break
        back = cut(back.unionByName(frontier))
    back = cut(back.where("distance > 0").select("root", F.col("id").alias("dst"), "distance"))
    paths, length = inner.join(back.withColumnRenamed("root", "src"), ["src", "dst"]).select(F.col("src").alias("root"), F.array("src", "dst").alias("path"), F.col("dst").alias("at")), 1
    while True:
        paths = cut(paths)
        if paths.isEmpty():
            return
        yield length, paths
        length += 1
        if length == max_length:
            return
        onward = paths.join(inner, F.col("at") == F.col("src")).where((F.col("dst") > F.col("root")) & ~F.array_contains("path", F.col("dst"))).join(back, ["root", "dst"])
        if max_length is not None:
            onward = onward.where(F.col("distance") + length <= max_length)
        paths = onward.select("root", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at"))


def short_cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """(path, length) of the elementary cycles of two edges to ``max_length``, from their smallest node.

    A cycle of n edges is ceil(n / 2) edges away from its smallest node and floor(n / 2) back to
    it, so paths of half the length are grown on both sides, through nodes above the root, and
    meet in the middle: work grows with the square root of what whole paths would take.
    """
    links = cut(edges.where("src <> dst").select("src", "dst").distinct())
    none = links.select(F.array("src", "dst").alias("path"), F.lit(0).alias("length")).where("false")
    away = links.where("src < dst").select(F.col("src").alias("root"), F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    # Back: nodes from the meeting place to the last one before the root.
    back = links.where("dst < src").select(F.col("dst").alias("root"), F.array("src").alias("rest"), F.col("src").alias("at"))
    done = none
    for length in range(2, max_length + 1):
        if length == 2:
            away, back = cut(away), cut(back)
        elif length % 2:
            grown = away.join(links, F.col("at") == F.col("src")).where((F.col("dst") > F.col("root")) & ~F.array_contains("path", F.col("dst")))
            away = cut(grown.select("root", F.array_append("path", F.col("dst")).alias("path"), F.col("dst").alias("at")))
        else:
            grown = back.join(links, F.col("at") == F.col("dst")).where((F.col("src") > F.col("root")) & ~F.array_contains("rest", F.col("src")))
            back = cut(grown.select("root", F.concat(F.array("src"), "rest").alias("rest"), F.col("src").alias("at")))
        # Both halves hold the meeting place, which must be all that they share.
        met = away.join(back, ["root", "at"]).withColumn("rest", F.slice("rest", 2, length)).where(~F.arrays_overlap("path", "rest"))
        done = done.unionByName(met.select(F.concat("path", "rest").alias("path"), F.lit(length).alias("length")))
    return done


def cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """(path, length) of all elementary cycles of two edges or more (up to ``max_length`` where that is given), from their smallest node."""
    if max_length is not None:
        return short_cycles(edges, max_length)
    links, done = edges.select("src", "dst").distinct(), None
    for length, paths in cycle_rounds(edges):
        closed = paths.join(links, (F.col("at") == F.col("src")) & (F.col("root") == F.col("dst"))).select("path", F.lit(length + 1).alias("length"))
        done = closed if done is None else done.unionByName(closed)
    if done is None:
        return edges.select(F.array("src", "dst").alias("path"), F.lit(0).alias("length")).where("false")
    return done


def ego_graph(edges: DataFrame, node, depth: int = 2) -> DataFrame:
    """Edges among the nodes within ``depth`` undirected steps of ``node``."""
    both = edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst"))).distinct()
    start = edges.sparkSession.createDataFrame([(node,)], ["id"]).select(F.col("id").cast(dict(edges.dtypes)["src"]).alias("id"))
    near = cut(reachable(both, start, depth).select("id").unionByName(start).distinct())
    return edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest node that is connected, whatever the direction (labels with pointer jumping)."""
    both = cut(edges.select("src", "dst").unionByName(reversed_edges(edges.select("src", "dst"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")))
    while True:
        offered = both.join(labels, F.col("src") == F.col("id")).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("offer"))
        lower = labels.join(offered, "id", "left").select("id", F.least("component", "offer").alias("component"))
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = cut(lower.join(jump, "component", "left").select("id", F.least("component", "further").alias("component")))
        changed = after.join(labels.withColumnRenamed("component", "was"), "id").where("component <> was")
        labels = after
        if changed.isEmpty():
            return labels


def is_dag(edges: DataFrame) -> bool:
    """Peel off nodes without incoming edges until none is left (true) or none can go (false)."""
    rest = cut(edges.select("src", "dst").distinct())
    count = rest.count()
    while count:
        rest = cut(rest.join(rest.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        before, count = count, rest.count()
        if count == before:
            return False
    return True


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges, density (4 digits), is_dag, n_components."""
    parts = weak_components(nodes, edges).agg(F.countDistinct("component").alias("n_components"))
    n, m = F.col("n_nodes"), F.col("n_edges")
    counts = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).crossJoin(parts)
    return counts.select("n_nodes", "n_edges", F.round(F.coalesce(F.try_divide(m, n * (n - 1)), F.lit(0.0)), 4).alias("density"), F.lit(is_dag(edges)).alias("is_dag"), "n_components")


def layer_violations(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Edges from a lower to a higher layer; ranks: id, rank (0: no layer)."""
    src = ranks.select(F.col("id").alias("src"), F.col("rank").alias("src_rank"))
    dst = ranks.select(F.col("id").alias("dst"), F.col("rank").alias("dst_rank"))
    return edges.join(src, "src").join(dst, "dst").where("src_rank > 0 AND dst_rank > 0 AND src_rank < dst_rank").select("src", "dst", "src_rank", "dst_rank")


def top_by_degree(nodes: DataFrame, edges: DataFrame, side: str, n: int) -> DataFrame:
    """The n nodes with most incoming (side='dst') or outgoing ('src') edges; ties by id."""
    counts = edges.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("degree"))
    out = nodes.select("id").join(counts, "id", "left").na.fill(0, ["degree"])
    return out.orderBy(F.desc("degree"), "id").limit(n)
