"""Questions to a graph, access, files of metadata, documents, routing, numbering."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lithograph.functions.order import numbered
from lithograph.operators import document, graph, questions, relational, retrieval, rules, structure
from lithograph.sources import java, metadata
from lithograph.streaming.events import work_folder


@pytest.fixture(scope="module")
def small(spark):
    nodes = spark.createDataFrame([(n, "p", t) for n, t in (("Ctrl", "controller"), ("Svc", "service"), ("Repo", "repository"), ("Util", "unknown"))], "id string, package string, class_type string")
    edges = spark.createDataFrame([("Ctrl", "Svc", "import"), ("Svc", "Repo", "field_injection"), ("Ctrl", "Repo", "import")], "src string, dst string, dep_type string")
    return nodes, edges


def told(rows):
    return [r.line for r in rows.orderBy("key").collect()]


def test_questions(small):
    assert told(questions.ask(*small, "who_depends_on", "Repo")) == ["  - Ctrl (controller) [direct, import]", "  - Svc (service) [direct, field_injection]"]
    assert told(questions.ask(*small, "get_dependencies", "Ctrl")) == ["  - Repo (repository) [direct]", "  - Svc (service) [direct]"]
    assert told(questions.ask(*small, "dependency_chain", source="Ctrl", target="Repo")) == ["Ctrl (controller) --[import]--> Repo (repository)"]
    assert told(questions.ask(*small, "dependency_chain", source="Repo", target="Ctrl")) == []
    assert told(questions.ask(*small, "orphans")) == ["  - Util"]
    assert told(questions.ask(*small, "most_depended_on")) == ["  - Repo (repository): 2 dependent(s)", "  - Svc (service): 1 dependent(s)"]
    assert told(questions.ask(*small, "what"))[0].startswith("Unknown query_type: what")


def test_shortest_path_is_the_first_of_the_shortest(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("c", "d"), ("b", "d"), ("d", "a")], "src string, dst string")
    assert graph.shortest_path(edges, "a", "d").first().path == ["a", "b", "d"]
    assert graph.shortest_path(edges, "a", "d", 1).count() == 0
    assert sorted(r.path for r in graph.cycles(edges).collect()) == [["a", "b", "d"], ["a", "c", "d"]]


def test_access(spark):
    pairs = spark.createDataFrame([(1, "admin", 10, 9), (2, "analyst", 10, 2), (3, "analyst", 10, 2), (4, "analyst", 10, None), (5, "analyst", 10, 2)], "user_id int, role string, id int, owner_id int")
    grants = spark.createDataFrame([(3, 10, "read"), (3, 10, "read"), (4, 10, "write")], "user_id int, id int, permission string")
    assert sorted(r.user_id for r in relational.may(pairs, grants).collect()) == [1, 2, 3, 4]
    assert sorted(r.user_id for r in relational.may(pairs, grants, ("write", "admin")).collect()) == [1, 2, 4]
    users = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, name string")
    changes = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, name string")
    assert [tuple(r) for r in relational.conflicts(users, changes, "id", "name").collect()] == [(1, "b")]
    assert {r.id: r.name for r in relational.set_where(users, F.col("name") == "a", name="z").collect()} == {1: "z", 2: "b", 3: None}


def test_numbered(spark):
    rows = spark.createDataFrame([(k % 3, (k * 7) % 50) for k in range(50)], "g int, v int").repartition(4)
    assert [r.v for r in numbered(rows, [F.col("v")]).orderBy("place").collect()] == list(range(50))
    for g in range(3):
        own = numbered(rows, [F.col("v")], group="g").where(F.col("g") == g).orderBy("place").collect()
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and [r.v for r in own] == sorted(r.v for r in own)


def test_metadata_files(spark):
    files = spark.createDataFrame([("A.java", bytearray(b"package p;\nclass A { }\n"))], "file_path string, content binary")
    path = work_folder(spark, "t")
    metadata.save_metadata(java.parse(files), path)
    assert [(r.file_path, r.classes, r.imports) for r in metadata.load_metadata(spark, path).collect()] == [("A.java", ["A"], [])]
    with pytest.raises(FileNotFoundError):
        metadata.load_metadata(spark, path + "x")
    assert metadata.load_text(spark, path + "x").count() == 0
    bad = work_folder(spark, "bad")
    spark.createDataFrame([("{not json",), ('{"file_path": "B.java"}',)], "value string").write.text(bad)
    rows = metadata.load_json(spark, bad, "file_path string").collect()
    assert sorted(str(r.file_path) for r in rows) == ["B.java", "None"]


def test_documents(spark):
    text = "package com.demo.a.service;\n@Service\npublic class OneService { @Autowired private OneRepository r; }\n"
    files = spark.createDataFrame([("a/OneService.java", bytearray(text.encode())), ("b/OneRepository.java", bytearray(b"package com.demo.a.repository;\npublic interface OneRepository { }\n")), ("c/Redis.java", bytearray(b"package com.demo.b;\nclass Redis { }"))], "file_path string, content binary")
    parsed = java.parse(files)
    roles = structure.detect(parsed)
    assert {r.class_name: (r.role, r.detection_method) for r in roles.collect()} == {"OneService": ("service", "annotation"), "OneRepository": ("repository", "naming"), "Redis": ("unknown", "unknown")}
    found = {level: document.sections(roles, *java.graph(parsed), "com.demo", level) for level in ("beginner", "expert")}
    assert found["beginner"].select("section").distinct().count() == 4
    assert "Cache" in " ".join(r.line for r in found["expert"].collect())
    path = work_folder(spark, "doc") + "/report.docx"
    n = document.save_packed(found["beginner"], path)
    raw = spark.read.format("binaryFile").load(path).first().content
    body = zipfile.ZipFile(io.BytesIO(bytes(raw))).read("word/document.xml").decode()
    assert body.count("<w:p>") == n and "1. Project Overview" in body
    assert {r.line for r in structure.layer_detail(roles, "Nowhere").collect()} == {"Available: Business", "Available: Persistence", "Available: Unknown"}


def test_routes(spark):
    asked = spark.createDataFrame([("Any security issues?", 0), ("What layers exist and any circular deps?", 1), ("hello", 0), ("review it", 8), (None, 0)], "question string, rounds int")
    got = [(r.agents, r.next) for r in questions.route(asked, rounds="rounds").collect()]
    assert got == [(["review"], "one"), (["architecture", "dependency"], "parallel"), ([], "synthesize"), ([], "synthesize"), ([], "synthesize")]


def test_containing(spark):
    needles = spark.createDataFrame([("abc",), ("Order",), ("OrderService",), ("zz",)], "n string")
    names = spark.createDataFrame([("xOrderServiceTest",), ("abcd",), ("z",)], "t string")
    assert sorted(r.n for r in rules.containing(needles, names, "n", "t").collect()) == ["Order", "OrderService", "abc"]


def test_titles_and_severities(spark):
    rule = rules.Rule("R", "tech_debt", "low", "{unit} has {hits}: {values}", r"//\s*(TODO|FIXME)", group=1, needs="//", worse=(3, "medium"))
    units = spark.createDataFrame([("A", "// TODO\n// FIXME"), ("B", "// TODO // TODO // TODO"), ("C", "none"), ("D", None)], "class_name string, content string")
    assert {r.title: r.severity for r in rules.findings(units, (rule,)).collect()} == {"A has 2: TODO, FIXME": "low", "B has 3: TODO, TODO, TODO": "medium"}
    assert rules.chosen((rule,), "security") == () and rules.chosen((rule,), "Security, tech_debt") == (rule,)


def test_greedy_choice_of_diverse_neighbours(spark):
    vectors = spark.createDataFrame([(k, [1.0, 0.1 * k]) for k in range(5)] + [(9, [0.0, 1.0])], "vec_id int, embedding array<float>")
    query = spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>")
    near = retrieval.cosine_top_k(vectors, query, 6)
    assert [v for _, v in retrieval.mmr(near, 2, 0.2)] == [0, 9]
    assert retrieval.hybrid(None, vectors, "x", query, 2).count() == 2
