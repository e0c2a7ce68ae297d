"""Operators on small hand-made tables with known results."""

import math

import pytest
from pyspark.sql import functions as F

from lithograph.operators import architecture, conversation, graph, relational, retrieval, rules, text


@pytest.fixture(scope="module")
def cycle(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("Orphan",)], "id string")
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "A")], "src string, dst string")
    return nodes, edges


def test_build_edges_keeps_strongest_internal(spark):
    nodes = spark.createDataFrame([("A",), ("B",)], "id string")
    raw = spark.createDataFrame([("A", "B", "import", 1, 0), ("A", "B", "constructor_injection", 9, 1), ("A", "X", "import", 2, 2), ("A", "A", "import", 3, 3), ("A", "B", "field_injection", 5, 4)], "src string, dst string, dep_type string, line int, seq int")
    found = graph.build_edges(raw, nodes, {"constructor_injection": 3, "field_injection": 2, "import": 1}).collect()
    assert [tuple(r) for r in found] == [("A", "B", "constructor_injection", 9)]


def test_cycle_orphan_and_stats(spark, cycle):
    nodes, edges = cycle
    assert [r.path for r in graph.cycles(edges, 5).collect()] == [["A", "B", "C"]]
    assert [r.id for r in graph.orphans(nodes, edges).collect()] == ["Orphan"]
    row = graph.stats(nodes, edges).first()
    assert (row.n_nodes, row.n_edges, row.density, row.is_dag, row.n_components) == (4, 3, 0.25, False, 2)


def test_coupling_chain(spark):
    nodes = spark.createDataFrame([("Ctrl",), ("Svc",), ("Repo",)], "id string")
    edges = spark.createDataFrame([("Ctrl", "Svc"), ("Svc", "Repo")], "src string, dst string")
    got = {r.id: (r.ca, r.ce, r.instability) for r in graph.degrees(nodes, edges).collect()}
    assert got == {"Ctrl": (0, 1, 1.0), "Svc": (1, 1, 0.5), "Repo": (1, 0, 0.0)}
    assert graph.is_dag(edges)


def test_closure_leaves_out_the_start_even_on_a_cycle(cycle):
    got = {(r.id, r.relationship) for r in graph.closure(graph.reversed_edges(cycle[1]), "A").collect()}
    assert got == {("C", "direct"), ("B", "transitive")}


def test_shortest_path_and_steps(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "D"), ("A", "C"), ("C", "D"), ("D", "E")], "src string, dst string")
    path = graph.shortest_path(edges, "A", "E")
    assert path.first().path == ["A", "B", "D", "E"]
    assert [(r.src, r.dst) for r in graph.path_steps(path, edges).orderBy("step").collect()] == [("A", "B"), ("B", "D"), ("D", "E")]
    assert graph.shortest_path(edges, "E", "A").count() == 0
    assert graph.ego_graph(edges, "E", 1).count() == 1


def test_layer_violation(spark):
    edges = spark.createDataFrame([("Repo", "Svc"), ("Ctrl", "Svc")], "src string, dst string")
    ranks = spark.createDataFrame([("Repo", 1), ("Svc", 2), ("Ctrl", 3)], "id string, rank int")
    assert [(r.src, r.dst) for r in graph.layer_violations(edges, ranks).collect()] == [("Repo", "Svc")]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, 1, "read"), (2, 1, "read")], "id int, ver int, p string")
    new = spark.createDataFrame([(1, 2, "write")], "id int, ver int, p string")
    once = relational.upsert_latest(old, new, ["id"], [F.col("ver")])
    twice = relational.upsert_latest(once, new, ["id"], [F.col("ver")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, 2, "write"), (2, 1, "read")]


def test_visible_and_partial_update(spark):
    rows = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (3, 9, "c")], "id int, owner_id int, name string")
    grants = spark.createDataFrame([(2, 7), (2, 7), (3, 5)], "id int, user_id int")
    assert sorted(r.id for r in relational.visible(rows, grants, 7).collect()) == [1, 2]
    changes = spark.createDataFrame([(1, None), (2, "z")], "id int, name string")
    assert {r.id: r.name for r in relational.partial_update(rows, changes, "id").collect()} == {1: "a", 2: "z", 3: "c"}


def test_score_and_grades(spark):
    schema = "severity string, category string"
    assert rules.quality_score(spark.createDataFrame([], schema), 0).first().score == 100.0
    for n, grade in ((0, "A"), (2, "B"), (4, "C"), (5, "D"), (7, "F")):
        found = spark.createDataFrame([("critical", "x")] * n, schema)
        assert rules.quality_score(found, 5).first().grade == grade


def test_findings_dedup_collapses_equal_class_sets(spark):
    rows = [("R", 0, "u1", ["a", "b"]), ("R", 0, "u0", ["b", "a", "a"]), ("R", 0, "u2", []), ("R", 0, "u3", [])]
    found = rules.dedup(spark.createDataFrame(rows, "rule_id string, rule_seq int, unit string, affected array<string>"))
    assert sorted(r.unit for r in found.collect()) == ["u0", "u2"]


def test_roles(spark):
    rows = [
        ("OrderController", "com.demo.controller", ["RestController", "RequestMapping"], []), ("OrderDTO", "com.demo.dto", [], []), ("DatabaseConfig", "com.demo", [], []),
        ("JwtFilter", "com.demo.security", [], []), ("Things", "com.demo", [], ["CrudRepository"]), ("Service", None, [], []), ("Orders", "com.demo", [], ["JpaRepository<Order, Long>"]),
    ]
    got = {r.class_name: (r.role, r.detection_method) for r in architecture.classify(spark.createDataFrame(rows, "class_name string, package string, annotations array<string>, interfaces array<string>")).collect()}
    assert got == {"OrderController": ("controller", "annotation"), "OrderDTO": ("dto", "naming"), "DatabaseConfig": ("configuration", "naming"), "JwtFilter": ("security", "package"), "Things": ("repository", "interface"), "Service": ("unknown", "unknown"), "Orders": ("repository", "interface")}


def test_packages(spark):
    packages = spark.createDataFrame([("com.demo.a",), ("com.demo.b.c",), ("com.demo",), ("",)], "package string")
    assert architecture.base_package(packages).first().base == "com.demo"
    parents = {r.package: r.parent for r in architecture.package_parents(packages).collect()}
    assert parents == {"com.demo.a": "com.demo", "com.demo.b.c": "com.demo", "com.demo": "", "": ""}
    counts = spark.createDataFrame([("a.b", 2), ("a.c", 3)], "package string, n int")
    assert {r.package: r.total for r in architecture.subtree_totals(counts).collect()} == {"a": 5, "a.b": 2, "a.c": 3}


def test_conversation_trim(spark):
    turns = [(1, 0, "system", "s")] + [(1, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(1, 21)]
    rows = spark.createDataFrame(turns, "conv_id int, turn int, role string, text string")
    assert sorted(r.turn for r in conversation.trim_history(rows, 2).collect()) == [0, 17, 18, 19, 20]
    assert conversation.last_answer(rows).first().turn == 20


@pytest.mark.parametrize("block", [text.BLOCK_SETS, 3])
def test_similar_sets_matches_brute_force(spark, block):
    import random

    r = random.Random(3)
    sets = {k: frozenset(r.sample(range(30), r.randint(3, 9))) for k in range(60)} | {100 + k: frozenset(range(5, 11)) for k in range(9)} | {200 + k: frozenset({50, 51, 52, 53, 60 + k}) for k in range(8)}
    sets |= {300: frozenset({1, 2}), 301: frozenset({1, 2})}
    table = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s] + [(5, v) for v in sets[5]], "k int, v int")
    pairs, members = text.similar_sets(table, "k", "v", 0.5, 3, block)
    kept = {k: s for k, s in sets.items() if len(s) >= 3}
    first = {s: min(k for k in kept if kept[k] == s) for s in set(kept.values())}
    assert {r.k: (r.representative, r.n) for r in members.collect()} == {k: (first[s], len(s)) for k, s in kept.items()}
    alike = {(a, b): len(sets[a] & sets[b]) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    own = set(first.values())
    assert {(x.a, x.b): x.shared for x in pairs.collect()} == {p: n for p, n in alike.items() if p[0] in own and p[1] in own}
    told = text.clone_pairs(pairs, members, "k").collect()
    assert sum(x.pairs for x in told) == len(alike) and {(x.a, x.b): (x.shared, x.pairs) for x in told}[(100, 100)] == (6, 36)


def test_equal_sets_and_common_values_do_not_meet_in_one_task(spark):
    """A thousand equal sets are one row of a join, and a value of 400 sets meets in cells of about 20."""
    items = spark.createDataFrame([(k, v) for k in range(1000) for v in range(6)] + [(2000 + k, v) for k in range(400) for v in (10, 11, 12, 13, 100 + k)], "k int, v int")
    pairs, members = text.similar_sets(items, "k", "v", 0.9, 3)
    assert pairs.count() == 0 and members.select("representative").distinct().count() == 401
    left, right = text._in_blocks(spark.range(400).selectExpr("id AS k", "'hot' AS v"), "v", "k", 20)
    cells = left.groupBy("cell_i", "cell_j").count().join(right.groupBy("cell_i", "cell_j").agg(F.count("*").alias("other")), ["cell_i", "cell_j"])
    most = cells.agg(F.max("count"), F.max("other"), F.sum(F.col("count") * F.col("other"))).first()
    assert most[0] <= 40 and most[1] <= 40 and most[2] == 400 * 400


def test_containing_by_the_rarest_gram(spark):
    import random

    r = random.Random(5)
    names = ["AbstractBaseOrder" + "".join(r.choices("abc", k=5)) + r.choice(["Service", "Test", ""]) for _ in range(500)] + ["", "x", "Order", None]
    needles = sorted({n[r.randrange(0, 12):][: r.randint(1, 14)] for n in names if n} | {"AbstractBaseOrder", "Order", "zz", "", "Service", "AbstractBaseOrderabcabcaX"})
    table = spark.createDataFrame([(n,) for n in needles] + [("Order",), (None,)], "n string")
    held = spark.createDataFrame([(n,) for n in names], "t string")
    expected = sorted(n for n in needles if any(n in t for t in names if t is not None))
    for block in (rules.GRAM_BLOCK, 7):
        assert sorted(x.n for x in rules.containing(table, held, "n", "t", block=block).collect()) == expected
    # The beginning that all names share is no needle's gram where it has another.
    index = rules.name_grams(held, "t", [5])
    rare = {x.n: (x._gram, x._n) for x in rules.rarest_grams(table.where(F.length("n") >= 5), index, "n", 5).collect()}
    assert all(n <= 60 for needle, (_, n) in rare.items() if needle.startswith("AbstractBaseOrder") and len(needle) > 21)
    assert rules.containing(table.where("n = ''"), held.limit(0), "n", "t").count() == 0


def test_retrieval(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id int, embedding array<float>")
    query = spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>")
    near = retrieval.cosine_top_k(vectors, query, 3)
    assert [r.vec_id for r in near.collect()] == [1, 2, 3]
    assert [v for _, v in retrieval.mmr(near, 2, 0.3)] == [1, 3]
    docs = spark.createDataFrame([(1, "cat sat"), (2, "dog sat down"), (3, "bird")], "doc_id int, text string")
    top = retrieval.bm25_top_k(docs, "cat", 2).collect()
    assert [r.doc_id for r in top] == [1] and top[0].score == pytest.approx((math.log(2.5) - math.log(1.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 2)))


def test_every_pair_of_equal_and_similar_sets(spark):
    """Pairs of representatives and members stand for all pairs; a large class of equal sets meets in blocks."""
    from itertools import combinations

    from lithograph.operators import text

    sets = {k: set("abcdef") for k in range(9)} | {20: set("abcdeg"), 21: set("abcdeg"), 30: set("xyz"), 31: set("xy")}
    items = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "k long, v string")
    found = {(r.a, r.b): (r.shared, round(r.similarity, 6)) for r in text.all_pairs(*text.similar_sets(items, "k", "v", 0.7, 3), "k", block=2).collect()}
    ok = {(a, b): (len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 3}
    assert found == {p: v for p, v in ok.items() if v[1] >= 0.7} and len(found) == 36 + 18 + 1
    assert text.all_pairs(*text.similar_sets(items, "k", "v", 0.7, 3), "k", block=2).count() == len(found)


def test_layer_numbers_of_more_than_five_digits(spark):
    """The query writes what its SQL writes; the operator itself keeps every digit."""
    from lithograph.operators import render

    rows = spark.range(123456).select(F.lit("Business").alias("layer"), F.lit("p").alias("package"))
    assert render.layer_lines(rows).first().text == "Business       123456 classes in 1 packages"
    assert render.layer_lines(rows, lambda n: F.lpad(n.cast("string"), 5, " ")).first().text == "Business       12345 classes in 1 packages"


def test_first_chunks_of_one_rank_have_an_order(spark):
    from lithograph.operators import retrieval

    rows = [("c", n, "a/P1.java", 7) for n in ("P1", "P1Row", "Kind", "P0")] + [("b", "P2", "a/P2.java", 3)]
    table = spark.createDataFrame(rows, "chunk_id string, class_name string, file_path string, rank long")
    for parts in (1, 4):
        assert [r.class_name for r in retrieval.explain(table.repartition(parts), "nowhere").collect()] == ["P2", "Kind", "P0", "P1Row"]
