"""Components, paths and cycles against brute force on random and planted graphs."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from lithograph.operators import graph


def closure(edges):
    after = collections.defaultdict(set)
    for a, b in edges:
        after[a].add(b)
    out = {}
    for start in {x for e in edges for x in e}:
        seen, todo = set(), [start]
        while todo:
            for b in after[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out[start] = seen
    return out


def walks(edges, source, done, extend, limit):
    after = collections.defaultdict(list)
    for a, b in sorted(set(edges)):
        after[a].append(b)
    found, todo = [], [[source]]
    while todo:
        path = todo.pop()
        for b in after[path[-1]]:
            if done(path, b):
                found.append([*path, b])
            elif b not in path and extend(path, b) and len(path) < limit:
                todo.append([*path, b])
    return found


def brute_cycles(edges, limit=99):
    nodes = {x for e in edges for x in e}
    return sorted(p[:-1] for r in nodes for p in walks(edges, r, lambda path, b: b == path[0] and len(path) > 1, lambda path, b: b > path[0], limit))


def brute_paths(edges, source, target, cutoff):
    return sorted(walks(edges, source, lambda path, b: b == target and b not in path, lambda path, b: True, cutoff))


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string").repartition(3)


def random_graph(seed, n, m):
    r = random.Random(seed)
    return [(f"n{r.randrange(n):02d}", f"n{r.randrange(n):02d}") for _ in range(m)] + [("n00", "n00"), ("n01", "n02"), ("n01", "n02")]


#: A long way in and out of a ring of nine with a chord, a ring of two beside it, and a diamond of many paths without a cycle.
PLANTED = [(f"r{k}", f"r{(k + 1) % 9}") for k in range(9)] + [("r2", "r6"), ("in0", "in1"), ("in1", "r0"), ("r4", "out0"), ("out0", "out1"), ("out1", "s0"), ("s0", "s1"), ("s1", "s0"), ("s1", "t")]
DIAMOND = [(f"d{k}{a}", f"d{k + 1}{b}") for k in range(7) for a in "xyz" for b in "xyz"] + [(f"d7{a}", "in0") for a in "xyz"]


@pytest.mark.parametrize("edges", [random_graph(1, 12, 26), PLANTED + DIAMOND, [("a", "b"), ("b", "c")]], ids=["random", "planted", "acyclic"])
def test_strong_components(spark, edges):
    reach = closure(edges)
    nodes = spark.createDataFrame([(x,) for x in [*reach, "alone"]], "id string")
    found = {r.id: r.component for r in graph.strong_components(nodes, frame(spark, edges)).collect()}
    assert found == {"alone": "alone"} | {a: min([a, *(b for b in reach[a] if a in reach[b])]) for a in reach}


def test_cycles(spark):
    edges = random_graph(2, 10, 22)
    assert sorted(r.path for r in graph.cycles(frame(spark, edges)).collect()) == brute_cycles(edges)
    assert sorted(r.path for r in graph.cycles(frame(spark, edges), 4).collect()) == brute_cycles(edges, 4)
    found = {tuple(r.path): r.length for r in graph.cycles(frame(spark, PLANTED + DIAMOND)).collect()}
    ring = tuple(f"r{k}" for k in range(9))
    assert found == {ring: 9, ring[:3] + ring[6:]: 6, ("s0", "s1"): 2}
    assert graph.cycles(frame(spark, DIAMOND)).count() == 0
    assert graph.cycles(frame(spark, []).limit(0)).count() == 0


def test_cycles_grow_inside_components_only(spark):
    """Three thousand paths through the acyclic part are never grown: one path for each of the ring's two ways, and one of the pair."""
    sizes = [paths.count() for _, paths in graph.cycle_rounds(frame(spark, PLANTED + DIAMOND))]
    assert max(sizes) <= 3 and len(sizes) == 8


def test_simple_paths(spark):
    edges = random_graph(3, 11, 26)
    for cutoff in (1, 4, 10):
        found = graph.simple_paths(frame(spark, edges), "n03", "n07", cutoff).collect()
        assert sorted(r.path for r in found) == brute_paths(edges, "n03", "n07", cutoff) and all(r.length == len(r.path) - 1 for r in found)
    assert graph.simple_paths(frame(spark, edges), "n03", "n03", 5).count() == 0
    assert graph.simple_paths(frame(spark, edges), "n03", "nowhere", 5).count() == 0


def test_paths_grow_towards_their_target_only(spark):
    """Of the diamond's 3 ** 7 paths none is grown beyond what can still reach the target within the cutoff."""
    edges = frame(spark, PLANTED + DIAMOND)
    sizes = {length: paths.count() for length, paths in graph.path_rounds(edges, "d0x", "d2y", 10)}
    assert sizes == {1: 3, 2: 3, 3: 0}
    near = {length: paths.count() for length, paths in graph.path_rounds(edges, "in0", "t", 11)}
    assert near[1] == 1 and max(near.values()) <= 2
    assert [r.distance for r in graph.distances(edges, spark.createDataFrame([("t",)], "id string")).where("id = 'in0'").collect()] == [graph.shortest_path(edges, "in0", "t").first().length]
    assert edges.where(F.col("src") == "t").count() == 0


def test_short_cycles_meet_in_the_middle(spark, monkeypatch):
    """Cycles of a bounded length need no components of the whole graph, and come from halves: every length and both parities."""
    monkeypatch.setattr(graph, "strong_components", lambda *_: pytest.fail("the whole graph was searched"))
    edges = random_graph(5, 9, 24)
    for limit in (1, 2, 3, 6):
        found = graph.cycles(frame(spark, edges), limit).collect()
        assert sorted(r.path for r in found) == (brute_cycles(edges, limit) if limit > 1 else []) and all(r.length == len(r.path) for r in found)


def test_a_large_component_goes_first(spark, monkeypatch):
    """With one large component and chains into and out of it, no least node has to be sent through the graph; many small components still are found."""
    ring = [(f"r{k:03d}", f"r{(k + step) % 150:03d}") for k in range(150) for step in (1, 3, 7, 31)]
    chains = [(f"in{k}", f"in{k + 1}") for k in range(5)] + [("in5", "r000"), ("r009", "out0")] + [(f"out{k}", f"out{k + 1}") for k in range(5)]
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in ring + chains for x in e})], "id string")
    first_sources = graph._first_sources
    monkeypatch.setattr(graph, "_first_sources", lambda _: pytest.fail("the large component was not found first"))
    found = {r.id: r.component for r in graph.strong_components(nodes, frame(spark, ring + chains)).collect()}
    assert found == {r.id: "r000" if r.id.startswith("r") else r.id for r in nodes.collect()}
    monkeypatch.setattr(graph, "_first_sources", first_sources)
    monkeypatch.setattr(graph, "GROWN_AFTER", 1)  # a search that does not spread is given up
    pairs = [(f"p{k}", f"q{k}") for k in range(5)] + [(f"q{k}", f"p{k}") for k in range(5)]
    found = {r.id: r.component for r in graph.strong_components(spark.createDataFrame([(x,) for e in pairs[:5] for x in e], "id string"), frame(spark, pairs)).collect()}
    assert found == {x: "p" + x[1] for e in pairs for x in e}
