"""The Java binding on small sources of our own."""

import pytest

from pyspark.sql import functions as F

from lithograph.operators import graph
from lithograph.sources import java

FILES = {
    "app/OrderService.java": 'package com.shop.service;\nimport java.util.List;\nimport com.shop.repo.OrderRepository;\nimport com.shop.model.*;\n/** @author me */\n@Service\npublic class OrderService {\n    // class Ghost {}\n    private final OrderRepository repository;\n    public OrderService(OrderRepository repository, Mailer mailer) { this.repository = repository; }\n    public List<String> getOrders(int n) { return null; }\n}\n',
    "app/OrderRepository.java": "package com.shop.repo;\n@Repository\npublic interface OrderRepository {\n    void save(Order o);\n}",
    "app/Mailer.java": "package com.shop;\npublic class Mailer {\n    @Autowired\n    private OrderService service;\n    String text = \"class Fake {}\";\n}",
    "app/target/Old.java": "class Old {}",
    "app/readme.txt": "no",
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, body in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
    return java.parse(java.scan(spark, str(root))).cache()


def test_metadata(parsed):
    rows = {r.file_path: r for r in parsed.collect()}
    assert set(rows) == {"app/OrderService.java", "app/OrderRepository.java", "app/Mailer.java"}
    service = rows["app/OrderService.java"]
    assert service.package == "com.shop.service" and service.imports == ["java.util.List", "com.shop.repo.OrderRepository", "com.shop.model"]
    assert service.classes == ["OrderService"] and service.annotations == ["Service"] and service.methods == ["OrderService", "getOrders"]
    assert service.lines_of_code == FILES["app/OrderService.java"].count("\n") + 1 and len(service.content_hash) == 32
    assert rows["app/OrderRepository.java"].interfaces == ["OrderRepository"] and rows["app/Mailer.java"].classes == ["Mailer"]


def test_edges(parsed):
    found = graph.build_edges(java.edges(parsed), java.nodes(parsed), java.EDGE_PRIORITY)
    assert {(r.src, r.dst, r.dep_type) for r in found.collect()} == {("OrderService", "OrderRepository", "constructor_injection"), ("OrderService", "Mailer", "constructor_injection"), ("Mailer", "OrderService", "field_injection")}


def test_incremental(spark, parsed):
    assert java.incremental(parsed, parsed).count() == 0
    assert java.incremental(parsed, parsed.limit(1)).count() == 2


def test_chunks(parsed):
    from lithograph.operators import chunking

    rows = chunking.chunk_files(parsed).where("class_name = 'OrderService'").orderBy("chunk_index").collect()
    assert [(r.chunk_type, r.chunk_index) for r in rows] == [("class_summary", 0), ("method", 1), ("method", 2)]
    assert "private final OrderRepository repository;" in rows[0].page_content and rows[2].page_content.endswith("{ return null; }")
    parts = chunking.chunk_files(parsed, most=10, size=40, overlap=10).where("chunk_type = 'method_part'").collect()
    assert {r.chunk_index // 1000 for r in parts} == {1, 2} and len({r.chunk_id for r in parts}) == len(parts)


def test_split_text_keeps_all_words():
    from lithograph.operators.chunking import split_text

    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(10)) + " " + "y" * 300
    parts = split_text(text, 100, 20)
    assert all(len(p) <= 100 or " " not in p for p in parts)
    assert set(text.split()) == {w for p in parts for w in p.split()}
    assert split_text("  \n", 10, 2) == [] and split_text("short", 10, 2) == ["short"]


def test_edges_of_every_top_level_type(spark):
    text = "package a;\n/* one\n two */\nimport com.x.Repo;\nclass A {\n  class In { @Inject Nope n; }\n}\nclass B {\n  @Autowired\n  private Mailer m;\n  char c = '{';\n  B(Clock c) { }\n}\nenum E { X, Y }\nrecord R(int n) { }\n"
    parsed = java.parse(spark.createDataFrame([("F.java", bytearray(text.encode()))], "file_path string, content binary"))
    found = {(r.src, r.dst, r.dep_type, r.line) for r in java.edges(parsed).collect()}
    assert found == {*((t, "Repo", "import", 4) for t in "ABER"), ("B", "Mailer", "field_injection", 9), ("B", "Clock", "constructor_injection", 12)}
    assert {r.id for r in java.nodes(parsed).collect()} == {"A", "B", "E", "R"}


def test_deep_long_and_hostile_bodies(spark):
    """Bodies of any depth and length, braces in literals, comments between, generics and package-private members."""
    deep = "class Deep { @Autowired private Repo r; String u = \"http://x{\"; @Inject Repo2 s; <T> Map<String, T> any(T t) { " + "if (a) { " * 200 + "}" * 200 + " }\n void last() { " + "x = x + 1; " * 2000 + "} }"
    text = "package p;\nclass Outer<T extends Comparable<T>> {\n  record In(int a) { In { } int twice() { return a; } }\n  int[] n = {1, 2}; char c = '}';\n  Outer(@Q(\"a,b\") Repo r, Map<String, Repo3> m, int k) { }\n}\n" + deep
    parsed = java.parse(spark.createDataFrame([("F.java", bytearray(text.encode())), ("Bad.java", bytearray(b"class X { void a( { } \xff")), ("Empty.java", bytearray())], "file_path string, content binary"))
    row = {r.file_path: r for r in parsed.collect()}["F.java"]
    assert row.classes == ["Outer", "Deep"] and row.methods == ["Outer", "twice", "any", "last"]
    found = {(r.src, r.dst, r.dep_type) for r in java.edges(parsed).collect()}
    assert found == {("Outer", "Repo", "constructor_injection"), ("Deep", "Repo", "field_injection"), ("Deep", "Repo2", "field_injection")}
    from lithograph.operators import chunking

    chunks = chunking.chunk_files(parsed.where("file_path = 'F.java'")).collect()
    assert {(c.class_name, c.chunk_type) for c in chunks} == {("Outer", "class_summary"), ("Outer", "method"), ("In", "class_summary"), ("In", "method"), ("Deep", "class_summary"), ("Deep", "method"), ("Deep", "method_part")}
    parts = [c for c in chunks if c.chunk_type == "method_part"]
    assert len(parts) > 10 and all(c.method == "last" and c.page_content.startswith("// package: p\n// class Deep\n") for c in parts)
    assert parsed.where("error IS NULL").count() == 3


def test_files_are_scanned_once_and_in_slices(spark, monkeypatch):
    """Chunks of all kinds, filters and explodes over parsed files stand on one scan of them; results are handed on slice by slice."""
    from lithograph.functions import values
    from lithograph.operators import chunking

    files = spark.createDataFrame([(f"F{k}.java", bytearray(f"package p;\nclass F{k} {{ void go() {{ }} }}\n".encode() if k % 3 else b"// note\n")) for k in range(40)], "file_path string, content binary")
    for rows in (chunking.chunk_files(java.parse(files)), java.edges(java.parse(files)), java.parse(files).where("size(types) > 0")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("run(content") == 1, plan
    seen = []
    monkeypatch.setattr(values, "SLICE_VALUES", 7)
    monkeypatch.setattr(values.F, "arrow_udf", lambda run, *_: type("Column", (), {"asNondeterministic": lambda self: run})())
    import pyarrow as pa

    sizes = [len(part) for part in values.per_value(lambda v: seen.append(v) or v, "string")(iter([pa.array(["x"] * 20), pa.array([], pa.string())]))]
    assert sizes == [7, 7, 6, 0] and len(seen) == 20


def test_small_keys_are_dealt_to_all_tasks(spark):
    """Keys that much work follows stay in as many partitions as were asked for, though adaptive execution would merge so few bytes."""
    from lithograph.plans.tables import dealt

    rows = dealt(spark.range(5000).withColumnRenamed("id", "k"), "k", per_task=500)
    counts = rows.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(counts) == 10 and max(r["count"] for r in counts) < 1000


def test_a_source_is_gone_through_once(monkeypatch):
    """The declarations of each body are found once, for its types and its members; comments on lines in a row are one match; long words take one step."""
    from lithograph.sources import java_types

    seen = []
    found = java_types.Source.declarations
    monkeypatch.setattr(java_types.Source, "declarations", lambda self, lo, hi: seen.append((lo, hi)) or found(self, lo, hi))
    text = "class A {\n  // one {\n\n \t// two é\n  // three\n  int x;\n  class B { void go() { } }\n  enum E { P { void no() { } }, Q; int n; E(A a) { } class C { } }\n}\n"
    types = java_types.read(text)["types"]
    assert [(t["name"], t["depth"], t["line"], [m["name"] for m in t["members"]]) for t in types] == [("A", 0, 1, ["x"]), ("B", 1, 7, ["go"]), ("E", 1, 8, ["n", "E"]), ("C", 2, 8, [])]
    assert len(seen) == len(set(seen)) == 1 + len(types)
    lines = "int a;\n" + "  // b {\n" * 500 + "int c;"
    assert len(java_types._BLANKED.findall(lines)) == 1
    assert java_types.blank(lines) == "int a;\n" + " " * 8 + ("\n" + " " * 8) * 499 + "\nint c;"
    assert java_types.blank("// é\n\t//  x\n") == "    \n      \n"


def test_generated_files_are_spread_over_tasks(spark):
    """The files that the queries scan come in as many partitions as there are cores at least, so no task scans them all."""
    from lithograph.plans import dependency_queries, java_queries, odd_queries

    sf, least = "/root/testdata/sf0.001", min(4, spark.sparkContext.defaultParallelism)
    for rows in (java_queries.java_files(spark, sf), dependency_queries.layered_files(spark, sf), odd_queries.parts(spark, sf)):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() >= least
