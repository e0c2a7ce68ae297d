"""Reports, parsed replies, metadata rules, and rules with look-around."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.functions.storage import cut
from lithograph.operators import reports as P
from lithograph.operators import review as V
from lithograph.operators import rules as E
from lithograph.plans import graph_queries as G
from lithograph.plans import rule_queries as Q
from lithograph.plans.tables import Catalog, table
from lithograph.streaming.events import work_folder

catalog = Catalog()

#: A model's reply to each turn of a conversation, the same text for both engines: prose, a JSON object in it, broken JSON, values that are not known.
_QUOTED = "translate(text, chr(10) || chr(92) || chr(34) || '{}', '     ')"
_REPLY = f"""CASE CAST((conv_id * 7 + turn) % 6 AS INT)
  WHEN 0 THEN 'Here: ' || chr(123) || '"findings": [' || chr(123) || '"category": "Security", "severity": "HIGH", "rule_id": "X-' || turn || '", "title": "' || {_QUOTED} || '"' || chr(125) || ', ' || chr(123) || '"category": "nonsense", "severity": "high", "title": "two"' || chr(125) || ']' || chr(125) || ' done' || chr(10) || 'ok'
  WHEN 1 THEN 'no braces at all: ' || translate(text, '{{}}', '  ')
  WHEN 2 THEN chr(123) || '"findings": [' || chr(123) || '"title": "' || role || '"' || chr(125) || ', ' || chr(123) || '"category": "solid", "severity": "grave", "title": "four"' || chr(125) || ']' || chr(125)
  WHEN 3 THEN chr(123) || '"findings": []' || chr(125) WHEN 4 THEN 'cut off: ' || chr(123) || '"findings": [' || chr(123)
  ELSE chr(123) || '"findings": [' || chr(123) || '"category": "patterns", "severity": "low", "rule_id": null, "title": "' || conv_id || '"' || chr(125) || ']' || chr(125) END"""


@catalog.add(f"""WITH b AS (SELECT conv_id, turn, regexp_extract(body, '(?s)\\{{.*\\}}') AS j FROM (SELECT conv_id, turn, {_REPLY} AS body FROM conversations)),
i AS (SELECT conv_id, turn, unnest(CAST(json_extract(j, '$.findings') AS JSON[])) AS f FROM b WHERE j <> ''),
x AS (SELECT conv_id, turn, lower(coalesce(f->>'category', 'maintainability')) AS category, lower(coalesce(f->>'severity', 'info')) AS severity, coalesce(f->>'rule_id', 'LLM-000') AS rule_id, coalesce(f->>'title', '') AS title FROM i)
SELECT * FROM x WHERE category IN ('solid', 'security', 'performance', 'maintainability', 'duplicates', 'tech_debt', 'patterns') AND severity IN ('critical', 'high', 'medium', 'low', 'info')""")
def parse_llm_findings(spark, sf):
    """The findings in the replies to all turns of all conversations."""
    replies = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.expr(_REPLY).alias("body"))
    return P.parse_findings(replies, "id", "body").select("id.*", "category", "severity", "rule_id", "title")


#: Each document as Markdown: every third line of it is a header, of a level and a title that its number gives.
_NOTE = "list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 1 THEN repeat('#', CAST(1 + (doc_id + i) % 4 AS INT)) || CASE WHEN (doc_id + i) % 5 = 0 THEN ' The Layers ' WHEN (doc_id + i) % 7 = 0 THEN 'layers, no header ' ELSE ' Part ' END || x[1:20] ELSE x END)"


@catalog.add(f"""WITH n AS (SELECT doc_id AS id, {_NOTE} AS ls FROM documents), l AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM n),
m AS (SELECT *, length(regexp_extract(line, '^(#+)\\s', 1)) AS lv FROM l), s AS (SELECT id, min(pos) AS p FROM m WHERE lv > 0 AND contains(lower(line), 'layers') GROUP BY id),
t AS (SELECT s.id, p, lv AS sl FROM s JOIN m ON m.id = s.id AND m.pos = p), e AS (SELECT t.id, min(pos) AS q FROM t JOIN m ON m.id = t.id AND pos > p AND lv > 0 AND lv <= sl GROUP BY t.id)
SELECT m.id AS doc_id, string_agg(line, chr(10) ORDER BY pos) AS section FROM m JOIN t ON t.id = m.id LEFT JOIN e ON e.id = m.id WHERE pos >= p AND pos < coalesce(q, 1000000) GROUP BY m.id""")
def markdown_section(spark, sf):
    """The section about layers of every document that has one."""
    docs = table(spark, sf, "documents")
    number = lambda i: F.col("doc_id") + i + 1
    title = lambda x, i: F.concat(F.repeat(F.lit("#"), (1 + number(i) % 4).cast("int")), F.when(number(i) % 5 == 0, " The Layers ").when(number(i) % 7 == 0, "layers, no header ").otherwise(" Part "), F.substring(x, 1, 20))
    note = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, title(x, i)).otherwise(x)), "\n")
    return P.markdown_section(docs.select("doc_id", note.alias("body")), "doc_id", "body", "Layers")


_FOUND = Q.findings_sql(Q._JAVA, Q.JAVA_RULES)
_ORD = Q._ORD


@catalog.add(_FOUND + Q._SCORE + f""", g AS ({Q._GRADE.strip()}), c AS (SELECT category, 10 * count(*) FILTER (WHERE severity = 'critical') + 5 * count(*) FILTER (WHERE severity = 'high') + 2 * count(*) FILTER (WHERE severity = 'medium') AS p FROM found GROUP BY category ORDER BY p DESC, category LIMIT 3)
SELECT format('{{}} findings ({{}} critical, {{}} high, {{}} medium). Score {{:.1f}} ({{}}). Focus: {{}}.', count(*), count(*) FILTER (WHERE severity = 'critical'), count(*) FILTER (WHERE severity = 'high'), count(*) FILTER (WHERE severity = 'medium'),
(SELECT score FROM g), (SELECT grade FROM g), (SELECT string_agg(category, ', ' ORDER BY p DESC, category) FROM c)) AS summary FROM found""")
def review_executive_summary(spark, sf):
    found = Q._java_findings(spark, sf)
    return P.executive_summary(found, E.quality_score(found, Q.java_units(spark, sf).count()), E.executive_top(found))


_PATH, _AT = "/repositories/demo", "2026-01-01 00:00 UTC"


def _case(column: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {Q._quote(v)}" for k, v in pairs.items()) + f" ELSE {default} END"


def _worded(place: int) -> str:
    return _case("rule_id", {k: v[place] for k, v in V.WORDING.items()}, _case("category", {k: v[place] for k, v in V.DEFAULT_WORDING.items()}, "''"))


# d: findings with all their fields; r: the facts.
_REVIEW = _FOUND + Q._SCORE + f""", g AS ({Q._GRADE.strip()}), c3 AS (SELECT category, 10 * count(*) FILTER (WHERE severity = 'critical') + 5 * count(*) FILTER (WHERE severity = 'high') + 2 * count(*) FILTER (WHERE severity = 'medium') AS p FROM found GROUP BY category ORDER BY p DESC, category LIMIT 3),
d AS (SELECT *, {_worded(0)} || ' Seen ' || hits || ' time(s) in ' || unit || '.' || CASE WHEN evidence <> '' THEN ' First: ' || evidence ELSE '' END AS description, {_worded(1)} AS recommendation, 'src/' || unit || '.java' AS file, CAST({_ORD} AS INT) AS o FROM found),
one AS (SELECT *, row_number() OVER (PARTITION BY rule_id, title[1:60] ORDER BY o, rule_seq, unit) AS k FROM d),
issues AS (SELECT row_number() OVER (ORDER BY o, rule_seq, unit) AS i, '[' || upper(severity) || '] ' || title AS issue FROM one WHERE k = 1 ORDER BY o, rule_seq, unit LIMIT 5),
cats AS (SELECT category, list_position(['solid', 'security', 'performance', 'maintainability', 'duplicates', 'tech_debt', 'patterns'], category) AS place, count(*) AS total, {", ".join(f"count(*) FILTER (WHERE severity = '{x}') AS {x}" for x in ("critical", "high", "medium", "low"))} FROM found GROUP BY category),
r AS (SELECT (SELECT count(*) FROM units) AS n, (SELECT count(*) FROM found) AS total_findings, (SELECT score FROM g) AS score, (SELECT grade FROM g) AS grade,
  (SELECT format('{{}} findings ({{}} critical, {{}} high, {{}} medium). Score {{:.1f}} ({{}}). Focus: {{}}.', count(*), count(*) FILTER (WHERE severity = 'critical'), count(*) FILTER (WHERE severity = 'high'), count(*) FILTER (WHERE severity = 'medium'),
    (SELECT score FROM g), (SELECT grade FROM g), (SELECT string_agg(category, ', ' ORDER BY p DESC, category) FROM c3)) FROM found) AS summary)"""


def _review(spark, sf):
    found = cut(Q._java_findings(spark, sf))
    units = Q.java_units(spark, sf)
    n = units.count()
    files = units.select(F.col("class_name").alias("unit"), F.concat(F.lit("src/"), "class_name", F.lit(".java")).alias("file"), F.array().cast("array<string>").alias("methods"))
    return V.review(found, _PATH, n, n, _AT, files)


@catalog.add(_REVIEW + f"""
SELECT 0 AS part, 0 AS severity_rank, -1 AS rule_seq, '' AS unit, CAST(unnest(range(10)) AS INT) AS k, unnest(['{V.RULE}', '  CODE REVIEW REPORT', '{V.RULE}', 'Repository    : {_PATH}', 'Files Reviewed: ' || n, 'Total Classes : ' || n, 'Total Findings: ' || total_findings, format('Quality Score : {{:.1f}}/100  (Grade: {{}})', score, grade), 'Generated At  : {_AT}', '']) AS line FROM r
UNION ALL SELECT 1, 0, -1, '', CAST(unnest(range(4)) AS INT), unnest(['EXECUTIVE SUMMARY', '{V.UNDER}', summary, '']) FROM r
UNION ALL SELECT 2, 0, -1, '', CAST(unnest(range(len(l))) AS INT), unnest(l) FROM (SELECT list_concat(['TOP ISSUES', '{V.UNDER}'], list('  ' || i || '. ' || issue ORDER BY i), ['']) AS l FROM issues HAVING count(*) > 0)
UNION ALL SELECT 3, 0, -1, '', CAST(unnest(range(len(l))) AS INT), unnest(l) FROM (SELECT list_concat(['FINDINGS BY CATEGORY', '{V.UNDER}'], list('  ' || rpad(category, 22, ' ') || ' ' || lpad(CAST(total AS VARCHAR), CAST(greatest(3, length(CAST(total AS VARCHAR))) AS INT), ' ') || ' total  (CRITICAL:' || critical || '  HIGH:' || high || '  MEDIUM:' || medium || '  LOW:' || low || ')' ORDER BY total DESC, category), ['']) AS l FROM cats HAVING count(*) > 0)
UNION ALL SELECT 4, o, -1, '', CAST(unnest(range(2)) AS INT), unnest([upper(severity) || ' FINDINGS (' || n || ')', '{V.UNDER}']) FROM (SELECT severity, o, count(*) AS n FROM d GROUP BY severity, o)
UNION ALL SELECT 4, o, rule_seq, unit, CAST(unnest(range(len(l))) AS INT), unnest(l) FROM (SELECT o, rule_seq, unit, list_filter(['  [' || rule_id || '] ' || title, '    Category : ' || category, '    Classes  : ' || unit, '    Desc     : ' || description[1:200], '    Fix      : ' || recommendation[1:200],
  CASE WHEN evidence <> '' THEN '    Evidence : ' || evidence[1:150] END, ''], lambda x: x IS NOT NULL) AS l FROM d)""")
def review_text_report(spark, sf):
    """The whole text of a review, as ordered lines."""
    return _review(spark, sf).text()


@catalog.add(_REVIEW + """ SELECT rule_id, category, severity, title, description, recommendation, file AS affected_files, unit AS affected_classes, '' AS affected_methods, coalesce(evidence, '') AS evidence FROM d""")
def review_json_report(spark, sf):
    """The findings of a review that was saved as JSON and read again, with all their fields."""
    path = work_folder(spark, "review")
    _review(spark, sf).save(path)
    rows = V.load(spark, path)[1]
    return rows.select(*(F.array_join(c, ",").alias(c) if c.startswith("affected") else F.col(c) for c in rows.columns))


@catalog.add(_REVIEW + f""" SELECT '{_PATH}' AS repository_path, n AS reviewed_files, n AS total_classes, total_findings, score AS quality_score, grade, summary, (SELECT string_agg(issue, '|' ORDER BY i) FROM issues) AS top_issues, '{_AT}' AS generated_at,
(SELECT string_agg(category || ':' || total || ':' || critical || ':' || high || ':' || medium || ':' || low, '|' ORDER BY place) FROM cats) AS category_summaries FROM r""")
def review_report_saved(spark, sf):
    """The facts of a review that was saved as JSON and read again."""
    path = work_folder(spark, "review")
    _review(spark, sf).save(path)
    facts = V.load(spark, path)[0]
    told = F.array_join(F.transform("category_summaries", lambda c: F.concat_ws(":", c["category"], *(c[x].cast("string") for x in ("total", "critical", "high", "medium", "low")))), "|")
    return facts.withColumns({"category_summaries": told, "top_issues": F.array_join("top_issues", "|")})


_OTHER = "split_part({0}, '_', 1) || '_' || (CAST(split_part({0}, '_', 2) AS BIGINT) + CASE WHEN CAST(split_part({0}, '_', 2) AS BIGINT) > {1} THEN -{1} ELSE {1} END)"


@catalog.add(_FOUND + f""", h AS (SELECT *, {_ORD} AS o FROM found WHERE severity IN ('critical', 'high') ORDER BY {_ORD}, rule_seq, unit LIMIT 5),
e AS (SELECT o, rule_seq, unit, 0 AS k, rule_id, unit AS class_name FROM h UNION ALL SELECT o, rule_seq, unit, 1, rule_id, {_OTHER.format('unit', len(Q.JAVA))} FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY o, rule_seq, unit, k) AS n FROM e)
SELECT CAST(row_number() OVER (ORDER BY o, rule_seq, f.unit, k) AS INT) AS place, class_name, rule_id, content[1:3000] AS snippet FROM f JOIN units ON units.unit = class_name WHERE n = 1 AND content <> ''""")
def review_first_snippets(spark, sf):
    """Texts of the classes that the gravest findings are about: here the class of a finding, the other one of its kind, and a third that is not told."""
    chunks = Q.java_units(spark, sf).select(F.col("class_name").alias("unit"), "content", F.lit(0).alias("chunk_index"))
    found = Q._java_findings(spark, sf).withColumn("affected_classes", F.array("unit", F.expr(_OTHER.format("unit", len(Q.JAVA))), F.lit("Third")))
    return P.first_snippets(found, chunks)


@catalog.add(G.EDGES + " SELECT 'graph LR' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS diagram FROM (SELECT '    ' || regexp_replace(s.n_name, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(d.n_name, '[^A-Za-z0-9_]', '_', 'g') AS line FROM edges JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst)")
def graph_mermaid(spark, sf):
    nation = table(spark, sf, "nation")
    named = G.edges(spark, sf).join(nation.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("a")), "src").join(nation.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("b")), "dst")
    return P.mermaid(named, "a", "b")


#: Rules on metadata: (rule_id, severity, condition over the columns of a class).  Fixed values: the thresholds.
METADATA_RULES = (
    ("SOLID-S001", "medium", "methods > 15"),
    ("SOLID-S002", "medium", "loc > 500"),
    ("SOLID-S002", "low", "loc > 300 AND loc <= 500"),
    ("MAINT-001", "low", "methods > 0 AND loc / methods > 40"),
    ("ANTI-001", "high", "loc > 800 OR methods > 30"),
    ("ANTI-001", "medium", "(loc >= 500 OR methods >= 20) AND NOT (loc > 800 OR methods > 30)"),
)

_META = "SELECT CAST(user_id AS VARCHAR) AS unit, count(*) FILTER (WHERE event_type = 'view') AS methods, count(*) * 7 AS loc FROM events GROUP BY user_id"


@catalog.add(f"WITH m AS ({_META}) " + " UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity, unit FROM m WHERE {c}" for r, s, c in METADATA_RULES))
def rule_metadata_thresholds(spark, sf):
    """Threshold rules over class metadata; users play classes, views methods and events lines."""
    m = table(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("unit")).agg(F.count_if(F.col("event_type") == "view").alias("methods"), (F.count("*") * 7).alias("loc"))
    checks = [F.when(F.expr(c), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, c in METADATA_RULES]
    return m.select("unit", F.inline(F.array_compact(F.array(*checks)))).select("rule_id", "severity", "unit")


@catalog.add("""SELECT name AS iface, count(DISTINCT doc_id) AS implementors FROM (SELECT doc_id, unnest(list_distinct(string_split(source, 'c'))) AS name FROM documents) WHERE name <> '' AND NOT ends_with(name, '7') GROUP BY name HAVING count(DISTINCT doc_id) >= 3""")
def strategy_implementors(spark, sf):
    """Interfaces with three implementors or more, but for exempt names."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.split("source", "c"))).alias("iface")).where("iface <> '' AND NOT endswith(iface, '7')")
    return rows.distinct().groupBy("iface").agg(F.count("*").alias("implementors")).where("implementors >= 3")


# Patterns that the computed rules count.
_BODY, _VALID, _WEB = r"@RequestBody", r"@(?:Valid|Validated)\b", r"@(?:RestController|Controller)\b"
_PARAMS = r"(?:public|protected|private)\s+[\w<>\[\]]+\s+\w+\s*\(([^)]+)\)"
_PRIMITIVE = r"(?:int|long|double|float|boolean|short|byte|char)\s+\w+"
_PUBLIC, _JAVADOC = r"public\s+[\w<>\[\]]+\s+\w+\s*\(", r"/\*\*"

def _hits(pattern):
    return f"len(regexp_extract_all(content, {Q._quote(pattern)}))"


_LINES = "string_split(content, chr(10))"
_COMMENTS = f"len(list_filter({_LINES}, lambda x: starts_with(trim(x), '//') OR starts_with(trim(x), '*') OR starts_with(trim(x), '/*')))"
_LISTS = f"regexp_extract_all(content, {Q._quote(_PARAMS)}, 1)"
_COMPUTED_SQL = {
    "SEC-003": ("medium", f"{_hits(_BODY)} > {_hits(_VALID)} AND {_hits(_WEB)} > 0"),
    "MAINT-007": ("medium", f"coalesce(list_max(list_transform({_LISTS}, lambda x: len(string_split(x, ',')))), 0) > 5"),
    "ANTI-005": ("low", f"coalesce(list_max(list_transform({_LISTS}, lambda x: len(regexp_extract_all(x, {Q._quote(_PRIMITIVE)})))), 0) >= 4"),
    "MAINT-009": ("info", f"len({_LINES}) >= 50 AND {_COMMENTS} < 0.05 * len({_LINES})"),
    "DEBT-003": ("low", f"{_hits(_PUBLIC)} > 0 AND {_hits(_JAVADOC)} < 0.5 * {_hits(_PUBLIC)}"),
}
@catalog.add(" UNION ALL ".join(f"SELECT '{r}' AS rule_id, '{s}' AS severity, unit FROM {Q._corpus_sql()} WHERE {c}" for r, (s, c) in _COMPUTED_SQL.items()))
def rule_findings_computed(spark, sf):
    """Rules that compare counts: validation, parameter lists, comments."""
    count = lambda p: F.size(F.regexp_extract_all("content", F.lit(p), F.lit(0)))
    lists = F.regexp_extract_all("content", F.lit(_PARAMS), F.lit(1))
    most = lambda f: F.coalesce(F.array_max(F.transform(lists, f)), F.lit(0))
    lines = F.split("content", "\n")
    comments = F.size(F.filter(lines, lambda x: F.trim(x).startswith("//") | F.trim(x).startswith("*") | F.trim(x).startswith("/*")))
    broken = {
        "SEC-003": (count(_BODY) > count(_VALID)) & (count(_WEB) > 0),
        "MAINT-007": most(lambda x: F.size(F.split(x, ","))) > 5,
        "ANTI-005": most(lambda x: F.size(F.regexp_extract_all(x, F.lit(_PRIMITIVE), F.lit(0)))) >= 4,
        "MAINT-009": (F.size(lines) >= 50) & (comments < 0.05 * F.size(lines)),
        "DEBT-003": (count(_PUBLIC) > 0) & (count(_JAVADOC) < 0.5 * count(_PUBLIC)),
    }
    checks = [F.when(c, F.struct(F.lit(r).alias("rule_id"), F.lit(_COMPUTED_SQL[r][0]).alias("severity"))) for r, c in broken.items()]
    units = Q.java_units(spark, sf).withColumnRenamed("class_name", "unit")
    return units.select("unit", F.inline(F.array_compact(F.array(*checks)))).select("rule_id", "severity", "unit")
