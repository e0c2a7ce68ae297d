"""A review as text and JSON; routes by name, synthesis, snippets."""

from pyspark.sql import functions as F

from lithograph.operators import document, questions, reports, review
from lithograph.streaming.events import work_folder

FOUND = "unit string, rule_seq int, rule_id string, category string, severity string, title string, hits int, evidence string"


def found(spark):
    return spark.createDataFrame([
        ("B", 1, "SEC-002", "security", "critical", "Hardcoded credential in B", 2, "x" * 600), ("A", 1, "SEC-002", "security", "critical", "Hardcoded credential in A", 1, ""),
        ("A", 4, "NEW-001", "patterns", "info", "Something in A", 1, None), ("C", 0, "SOLID-S002", "solid", "low", "SRP: C is too large (400 LOC)", 1, "y"),
    ], FOUND)


def test_review(spark):
    files = spark.createDataFrame([("A", "src/A.java", ["go", "stop"])], "unit string, file string, methods array<string>")
    made = review.review(found(spark), "/r", 3, 3, "2026-01-01 00:00 UTC", files)
    order = ("part", "severity_rank", "rule_seq", "unit", "k")
    lines = [r.line for r in made.text().orderBy(*order).collect()]
    text = "\n".join(lines)
    assert lines[0] == lines[2] == "=" * 62 and "Total Findings: 4" in lines and "Quality Score : 79.0/100  (Grade: B)" in lines
    assert lines.index("TOP ISSUES") < lines.index("FINDINGS BY CATEGORY") < lines.index("CRITICAL FINDINGS (2)") < lines.index("LOW FINDINGS (1)") < lines.index("INFO FINDINGS (1)")
    assert text.index("  [SEC-002] Hardcoded credential in A") < text.index("  [SEC-002] Hardcoded credential in B")
    assert "  security                 2 total  (CRITICAL:2  HIGH:0  MEDIUM:0  LOW:0)" in lines and "  1. [CRITICAL] Hardcoded credential in A" in lines
    assert max(len(x) for x in lines if x.startswith("    Evidence : ")) == len("    Evidence : ") + 150 and max(len(x) for x in lines if x.startswith("    Desc     : ")) == len("    Desc     : ") + 200
    path = work_folder(spark, "review")
    made.save(path)
    facts, rows = review.load(spark, path)
    row = facts.first()
    assert (row.repository_path, row.reviewed_files, row.total_findings, row.grade, row.generated_at) == ("/r", 3, 4, "B", "2026-01-01 00:00 UTC") and row.top_issues[0].startswith("[CRITICAL]")
    assert [(c.category, c.total, c.critical) for c in row.category_summaries] == [("solid", 1, 0), ("security", 2, 2), ("patterns", 1, 0)]
    kept = {(r.rule_id, r.affected_classes[0]): r for r in rows.collect()}
    assert len(kept["SEC-002", "B"].evidence) == 500 and kept["SEC-002", "A"].affected_files == ["src/A.java"] and kept["SEC-002", "A"].affected_methods == ["go", "stop"] and kept["SEC-002", "B"].affected_files == []
    assert kept["NEW-001", "A"].recommendation == review.DEFAULT_WORDING["patterns"][1] and "Seen 2 time(s) in B" in kept["SEC-002", "B"].description
    assert review.load(spark, path + "-none")[1].count() == 0


def test_review_without_findings(spark):
    made = review.review(found(spark).limit(0), "/r", 0, 0, "now")
    lines = [r.line for r in made.text().orderBy("part", "k").collect()]
    assert "Quality Score : 100.0/100  (Grade: A)" in lines and "TOP ISSUES" not in lines and "FINDINGS BY CATEGORY" not in lines
    assert made.json().count() == 1


def test_snippets_of_the_gravest(spark):
    rows = found(spark).withColumn("affected_classes", F.when(F.col("unit") == "A", F.array(F.lit("A"), F.lit("D"), F.lit("E"))).otherwise(F.array(F.lit("B"), F.lit("A"))))
    chunks = spark.createDataFrame([("A", "a2", 1), ("A", "a1", 0), ("B", "b" * 9, 0), ("D", "", 0), ("E", "e", 0), ("C", "c", 0)], "unit string, content string, chunk_index int")
    assert [(r.class_name, r.rule_id, r.snippet) for r in reports.first_snippets(rows, chunks, width=4).orderBy("place").collect()] == [("A", "SEC-002", "a1"), ("B", "SEC-002", "bbbb")]


def test_named_routes_and_synthesis(spark):
    asked = spark.createDataFrame([(["search", "who", "search", "docs"], 0), (["docs"], 1), (["nobody"], 1), (["docs", "FINISH"], 1), (["docs"], 8), (None, 0), ([], 0)], "next_agents array<string>, rounds int")
    got = [(r.agents, r.next) for r in questions.named_route(asked, rounds="rounds").collect()]
    assert got == [(["search", "docs"], "parallel"), (["docs"], "one"), ([], "synthesize"), ([], "synthesize"), ([], "synthesize"), ([], "synthesize"), ([], "synthesize")]
    results = spark.createDataFrame([("docs", "2", "two"), ("docs", "1", "one"), ("review", "1", "fine")], "agent string, key string, line string")
    lines = [r.line for r in questions.synthesis("why?", results).orderBy("part", "agent", "key").collect()]
    assert lines == ["Question: why?", "", "Specialist Agent Results:", "--- DOCS AGENT ---", "one", "two", "--- REVIEW AGENT ---", "fine", "", "Synthesize a complete, grounded answer:"]
    assert questions.synthesis("why?", results.limit(0)).first().line.startswith("No information")


def test_packed_files_have_no_largest_size(spark):
    import io
    import zipfile

    rows = spark.range(30_000).selectExpr("CAST(id DIV 10000 AS INT) AS section", "0 AS part", "lpad(CAST(id AS STRING), 8, '0') AS key", "CASE WHEN id % 10000 = 0 THEN '## Head <1> & more' ELSE concat('line ', id, chr(7), ' <b>') END AS line")
    path = work_folder(spark, "packed") + "/long.docx"
    assert document.save_packed(rows, path) == 30_000
    raw = spark.read.format("binaryFile").load(path).first().content
    body = zipfile.ZipFile(io.BytesIO(bytes(raw))).read("word/document.xml").decode()
    assert body.count("<w:p>") == 30_000 and body.index("line 1 &lt;b&gt;") < body.index("line 29999 ") and body.count("<w:b/>") == 3 and "Head &lt;1&gt; &amp; more" in body
