"""Java sources as a table: a file made of each part, read by the scanner, held against SQL.

The text of a file is one expression over ``p_partkey`` that both engines evaluate, so the
scanner has the whole table to read.  The SQL never parses: it says from the same numbers
what a file declares.  Files hold comments, literals and annotations with braces and
keywords in them, deep and long bodies, nested and second top-level types, and paths that
a scan leaves out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.functions.storage import saved
from lithograph.operators import chunking, reports, rules
from lithograph.operators import graph as G
from lithograph.plans.tables import Catalog, dealt, table
from lithograph.sources import java
from lithograph.streaming.events import work_folder
from lithograph.streaming.ingest import ChunkIndex, ingest

catalog = Catalog()


def _name(k: str) -> str:
    return f"('P' || {k} || CASE {k} % 6 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Service' WHEN 2 THEN 'Repository' WHEN 3 THEN 'Entity' WHEN 4 THEN 'Config' ELSE 'Helper' END)"


def _package(k: str) -> str:
    return f"('com.demo.m' || ({k} % 5) || CASE {k} % 6 WHEN 0 THEN '.controller' WHEN 1 THEN '.service' WHEN 2 THEN '.repository' WHEN 3 THEN '.entity' WHEN 4 THEN '.config' ELSE '.util' END)"


_NL = "chr(10)"
_CLASS = (
    "'/* class Fake' || k || ' { } */'", "'package ' || package || ';'", "''", "'import java.util.List;'", "'import ' || a_package || '.' || a || ';'", "'import static com.demo.util.Texts.join;'", "'import com.demo.shared.*;'",
    "CASE WHEN k % 13 = 0 THEN '" + " ".join(f"import d{i % 6}.p{i % 6}.x{i};" for i in range(22)) + "' ELSE '' END",
    "'/** @author nobody { */'", "marks", "'public class ' || name || ' extends Base' || (k % 3) || ' implements Runnable, Comparable<' || name || '> {'", "'    // TODO class Hidden { }'",
    "'    private String url = \"http://x.io/{\" + 1; @Autowired private ' || b || ' b;'", "'    public ' || name || '(' || c || ' c, int n) {'",
    "'        if (n > 0) { while (n > 1) { for (;;) { try { n--; } finally { if (n > 2) { n = 0; } } } } }'", "'    }'", "'    public List<String> find(int a, String b) { return null; }'", "'    void plain() { }'",
    "CASE WHEN k % 9 = 0 THEN '    public int big() {' || chr(10) || repeat('        total = total + 1;' || chr(10), 150) || '        return total; }' ELSE '    int none;' END", "'    enum Kind { ONE, TWO }'", "'}'",
    "CASE k % 8 WHEN 0 THEN 'interface ' || name || 'Port { void go(' || name || ' x); }' WHEN 1 THEN 'record ' || name || 'Row(int a) { }' WHEN 2 THEN 'class ' || b || 'Test { }' ELSE '' END",
)
_INTERFACE = (
    "'/* class Fake' || k || ' { } */'", "'package ' || package || ';'", "''", "'import ' || e_package || '.' || e || ';'", "''",
    "'public interface ' || name || ' extends JpaRepository<' || e || ', Long> {'", "'    List<' || e || '> findByName(String name);'", "'}'",
)

#: Columns in steps, each over those before it; the same text for both engines.
STEPS = (
    {"ka": "(k * 7 + 3) % n + 1", "kb": "(k * 11 + 5) % n + 1", "kc": "(k * 14 + 1) % n + 1", "ke": "(k * 17 + 2) % n + 1"},
    {"name": _name("k"), "package": _package("k"), "a": _name("ka"), "a_package": _package("ka"), "b": _name("kb"), "c": _name("kc"), "e": _name("ke"), "e_package": _package("ke"), "is_class": "k % 6 <> 2",
     "marks": "CASE k % 6 WHEN 0 THEN '@RestController @RequestMapping(\"/p{' || k || '\")' WHEN 1 THEN '@Service' WHEN 3 THEN '@Entity @Table(name = \"t\")' WHEN 4 THEN '@org.x.Configuration' ELSE '@Deprecated' END"},
    {"source": f"CASE WHEN is_class THEN {f' || {_NL} || '.join(_CLASS)} ELSE {f' || {_NL} || '.join(_INTERFACE)} END",
     "file_path": "CASE WHEN k % 50 = 0 THEN 'app/target/' ELSE 'app/src/' END || replace(package, '.', '/') || '/' || name || CASE WHEN k % 37 = 0 THEN '.txt' ELSE '.java' END"},
)


def java_files(spark, sf):
    """(file_path, content) of a file for each part."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"))
    # One small part file is one split, and keys alone are so small that they would be merged into one again.
    rows = dealt(part, "k").crossJoin(F.broadcast(part.agg(F.count("*").alias("n"))))
    for step in STEPS:
        rows = rows.selectExpr("*", *(f"{e} AS {c}" for c, e in step.items()))
    return rows.select("file_path", F.col("source").cast("binary").alias("content"))


def parsed(spark, sf):
    return java.parse(java.supported(java_files(spark, sf)))


def kept(spark, sf):
    """Parsed files that are read more than once: what they declare, without their texts."""
    bare = F.transform("types", lambda t: t.dropFields("header").withField("members", F.transform(t["members"], lambda m: m.dropFields("signature", "text"))))
    return saved(parsed(spark, sf).drop("source").withColumn("types", bare))


def _steps_sql() -> str:
    out = ["s0 AS (SELECT CAST(p_partkey AS BIGINT) AS k, (SELECT count(*) FROM part) AS n FROM part)"]
    for i, step in enumerate(STEPS):
        out.append(f"s{i + 1} AS (SELECT *, " + ", ".join(f"{e} AS {c}" for c, e in step.items()) + f" FROM s{i})")
    return ", ".join(out)


def _case(column: str, table_: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE '{default}' END"


# What the files declare: f the files, t the top-level types, x all edges, d the best of a pair in a file.
_FILES = f"""WITH {_steps_sql()}, f AS (SELECT * FROM s{len(STEPS)} WHERE k % 50 <> 0 AND k % 37 <> 0),
t AS (SELECT k, 1 AS place, name AS id, package, file_path, CASE k % 6 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 4 THEN 'configuration' ELSE 'unknown' END AS class_type,
        CASE k % 6 WHEN 0 THEN 'RestController,RequestMapping' WHEN 1 THEN 'Service' WHEN 2 THEN '' WHEN 3 THEN 'Entity,Table' WHEN 4 THEN 'Configuration' ELSE 'Deprecated' END AS annotations, CASE WHEN is_class THEN 'class' ELSE 'interface' END AS kind FROM f
      UNION ALL SELECT k, 3, CASE k % 8 WHEN 0 THEN name || 'Port' WHEN 1 THEN name || 'Row' ELSE b || 'Test' END, package, file_path, 'unknown', '', CASE k % 8 WHEN 0 THEN 'interface' WHEN 1 THEN 'record' ELSE 'class' END FROM f WHERE is_class AND k % 8 < 3),
x AS (SELECT t.id AS src, a AS dst, 'import' AS dep_type, 1 AS prio, f.file_path, 5 AS line, 0 AS seq FROM f JOIN t ON t.k = f.k WHERE is_class
      UNION ALL SELECT name, e, 'import', 1, file_path, 4, 0 FROM f WHERE NOT is_class
      UNION ALL SELECT name, b, 'field_injection', 2, file_path, 13, 1 FROM f WHERE is_class UNION ALL SELECT name, c, 'constructor_injection', 3, file_path, 14, 2 FROM f WHERE is_class),
d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, file_path ORDER BY prio DESC, seq) AS r FROM x WHERE src <> dst) WHERE r = 1)"""

_GRAPH = _FILES + """, nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file_path DESC, place DESC) AS r FROM t) WHERE r = 1),
inner_edges AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY prio DESC, file_path, seq) AS best, first_value(file_path) OVER (PARTITION BY src, dst ORDER BY file_path, seq) AS source_file FROM d WHERE dst IN (SELECT id FROM t)),
edges AS (SELECT src, dst, dep_type, source_file, line FROM inner_edges WHERE best = 1)"""


@catalog.add(f"WITH {_steps_sql()} SELECT file_path, md5(source) AS content_hash, CAST(strlen(source) AS BIGINT) AS bytes FROM s{len(STEPS)} WHERE k % 50 <> 0 AND k % 37 <> 0")
def java_scan(spark, sf):
    """The files as a tree in a folder, scanned: excluded directories and other extensions are not opened."""
    root = work_folder(spark, "tree [a+b], {c}")
    java.write_tree(java_files(spark, sf), root)
    return java.scan(spark, root).select("file_path", F.md5("content").alias("content_hash"), F.length("content").cast("long").alias("bytes"))


@catalog.add(_FILES + """, m AS (SELECT f.*, CASE WHEN is_class THEN marked || ',Autowired' ELSE '' END AS annotations FROM (SELECT f.*, t.annotations AS marked FROM f JOIN t ON t.k = f.k AND t.place = 1) f)
SELECT file_path, package, CASE WHEN is_class THEN 'java.util.List,' || a_package || '.' || a || ',com.demo.util.Texts.join,com.demo.shared' || CASE WHEN k % 13 = 0 THEN '""" + "".join(f",d{i % 6}.p{i % 6}.x{i}" for i in range(22)) + """' ELSE '' END ELSE e_package || '.' || e END AS imports,
annotations, CASE WHEN is_class THEN name || CASE WHEN k % 8 = 2 AND b || 'Test' <> name THEN ',' || b || 'Test' ELSE '' END ELSE '' END AS classes, CASE WHEN NOT is_class THEN name WHEN k % 8 = 0 THEN name || 'Port' ELSE '' END AS interfaces,
CASE WHEN is_class THEN 'Kind' ELSE '' END AS enums, CASE WHEN is_class THEN name || ',find,plain' || CASE WHEN k % 9 = 0 THEN ',big' ELSE '' END || CASE WHEN k % 8 = 0 THEN ',go' ELSE '' END ELSE 'findByName' END AS methods,
CASE WHEN NOT is_class THEN 8 WHEN k % 9 = 0 THEN 173 ELSE 22 END AS lines_of_code, md5(source) AS content_hash FROM m""")
def java_metadata(spark, sf):
    joined = lambda *names: [F.array_join(c, ",").alias(c) for c in names]
    return parsed(spark, sf).select("file_path", "package", *joined("imports", "annotations", "classes", "interfaces", "enums", "methods"), "lines_of_code", "content_hash")


@catalog.add(_FILES + " SELECT id AS name, kind, 0 AS depth, file_path FROM t UNION ALL SELECT 'Kind', 'enum', 1, file_path FROM f WHERE is_class")
def java_types(spark, sf):
    return java.types(parsed(spark, sf)).select("name", "kind", "depth", "file_path")


@catalog.add(_FILES + " SELECT src, dst, dep_type, file_path AS source_file, line FROM d")
def java_edges(spark, sf):
    return java.edges(parsed(spark, sf)).select("src", "dst", "dep_type", "source_file", "line")


@catalog.add(_GRAPH + f" SELECT id, package, class_type, annotations, file_path, {_case('class_type', java.NODE_COLORS, '')} AS color FROM nodes")
def java_nodes(spark, sf):
    return java.nodes(parsed(spark, sf)).select("id", "package", "class_type", F.array_join("annotations", ",").alias("annotations"), "file_path", "color")


@catalog.add(_GRAPH + " SELECT * FROM edges")
def java_graph_edges(spark, sf):
    return java.graph(kept(spark, sf))[1]


_RANK = "CASE class_type WHEN 'controller' THEN 3 WHEN 'service' THEN 2 WHEN 'component' THEN 2 WHEN 'repository' THEN 1 WHEN 'bean' THEN 1 ELSE 0 END"


@catalog.add(_GRAPH + f" SELECT src, dst FROM edges JOIN (SELECT id, {_RANK} AS r FROM nodes) s ON s.id = src JOIN (SELECT id, {_RANK} AS r FROM nodes) e ON e.id = dst WHERE s.r > 0 AND e.r > 0 AND s.r < e.r")
def java_layer_violations(spark, sf):
    nodes, edges = java.graph(kept(spark, sf))
    ranks = nodes.select("id", F.expr(_RANK).alias("rank"))
    return G.layer_violations(edges, ranks).select("src", "dst")


@catalog.add(_GRAPH + " SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges) AND id NOT IN (SELECT dst FROM edges)")
def java_orphans(spark, sf):
    nodes, edges = java.graph(kept(spark, sf))
    return G.orphans(nodes, edges)


_DEGREES = _GRAPH + """, deg AS (SELECT id, coalesce(a.n, 0) AS ca, coalesce(e.n, 0) AS ce FROM nodes LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) a ON a.dst = id LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) e ON e.src = id)"""


@catalog.add(_DEGREES + " SELECT id, ca, ce, round(CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END, 3) AS instability, ca + ce > 4 AS highly_coupled FROM deg")
def java_coupling(spark, sf):
    return G.degrees(*java.graph(kept(spark, sf)))


@catalog.add(_DEGREES + """, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) SELECT d.id AS name, class_type, ca AS dependents FROM deg d JOIN nodes n ON n.id = d.id WHERE ca > 0 ORDER BY ca DESC, d.id LIMIT 10""")
def java_most_depended_on(spark, sf):
    nodes, edges = java.graph(kept(spark, sf))
    return G.top_by_degree(nodes, edges, "dst", 10).where("degree > 0").join(nodes.select("id", "class_type"), "id").select(F.col("id").alias("name"), "class_type", F.col("degree").alias("dependents"))


_JSON_NODE = """'{"id":"' || id || '","package":"' || package || '","class_type":"' || class_type || '","annotations":[' || CASE WHEN annotations = '' THEN '' ELSE '"' || replace(annotations, ',', '","') || '"' END || '],"file_path":"' || file_path || '"}'"""
_JSON_EDGE = """'{"source":"' || src || '","target":"' || dst || '","dep_type":"' || dep_type || '","line":' || line || '}'"""


@catalog.add(_GRAPH + f" SELECT 'nodes' AS part, id AS key, {_JSON_NODE} AS json FROM nodes UNION ALL SELECT 'edges', src || '>' || dst, {_JSON_EDGE} FROM edges UNION ALL SELECT 'stats', '', '{{\"total_classes\":' || (SELECT count(*) FROM nodes) || ',\"total_dependencies\":' || (SELECT count(*) FROM edges) || '}}'")
def java_adjacency_json(spark, sf):
    nodes, edges = java.graph(kept(spark, sf))
    return reports.adjacency_rows(nodes, edges)


@catalog.add(_GRAPH + f""" SELECT 1 AS part, id AS key, '  "' || id || '" [label="' || id || '\\n[' || class_type || ']' || CASE WHEN package <> '' THEN '\\n' || package ELSE '' END || '", fillcolor="' || {_case('class_type', reports.DOT_FILL, 'lightgray')} || '"];' AS line FROM nodes
UNION ALL SELECT 2, src || '>' || dst, '  "' || src || '" -> "' || dst || '" [style="' || {_case('dep_type', {k: v[0] for k, v in reports.DOT_EDGE_STYLE.items()}, 'dashed')} || '", color="' || {_case('dep_type', {k: v[1] for k, v in reports.DOT_EDGE_STYLE.items()}, 'gray')} || '", label="' || dep_type || '"];' FROM edges
UNION ALL SELECT 0, lpad(CAST(unnest(range({len(reports.DOT_HEAD)})) AS VARCHAR), 2, '0'), unnest([{", ".join("'" + x + "'" for x in reports.DOT_HEAD)}]) UNION ALL SELECT 3, '00', '}}'""")
def java_dot(spark, sf):
    """Lines of a Graphviz text in order (part, key)."""
    return reports.dot_rows(*java.graph(kept(spark, sf)))


_PARTS = [(0, 0, 54), (1, 48, 102), (2, 96, 150), (3, 144, 151)]
_HEADER = "CASE WHEN t.place = 3 THEN t.kind || ' ' || t.id || CASE WHEN t.kind = 'record' THEN ' (int a)' ELSE '' END WHEN is_class THEN marks || chr(10) || 'public class ' || name || ' extends Base' || (f.k % 3) || ' implements Runnable, Comparable<' || name || '>' ELSE 'public interface ' || name || ' extends JpaRepository<' || e || ', Long>' END"
_MADE = "'public ' || name || '(' || c || ' c, int n) {' || chr(10) || '        if (n > 0) { while (n > 1) { for (;;) { try { n--; } finally { if (n > 2) { n = 0; } } } } }' || chr(10) || '    }'"
_CHUNKS = _FILES + f""", h AS (SELECT f.*, t.id, t.place, t.kind AS kind, t.annotations, {_HEADER} AS header FROM f JOIN t ON t.k = f.k
  UNION ALL SELECT f.*, 'Kind', 2, 'enum', '', 'enum Kind' FROM f WHERE is_class),
p AS (SELECT *, '// package: ' || package || chr(10) || CASE WHEN annotations <> '' THEN '// class annotations: ' || replace(annotations, ',', ', ') || chr(10) ELSE '' END || '// ' || header || chr(10) AS head FROM h),
bodies AS (
  SELECT *, 'class_summary' AS chunk_type, 0 AS chunk_index, NULL AS method, header || ' {{' || chr(10) || CASE
    WHEN place = 1 AND is_class THEN '    private String url = "http://x.io/{{" + 1;' || chr(10) || '    @Autowired private ' || b || ' b;' || chr(10) || CASE WHEN k % 9 = 0 THEN '' ELSE '    int none;' || chr(10) END
      || '    ' || replace({_MADE}, '(' || c, ' (' || c) || ';' || chr(10) || '    public List<String> find (int a, String b);' || chr(10) || '    void plain ();' || CASE WHEN k % 9 = 0 THEN chr(10) || '    public int big ();' ELSE '' END
    WHEN place = 1 THEN '    List<' || e || '> findByName (String name) ;;' WHEN kind = 'interface' THEN '    void go (' || name || ' x) ;;' ELSE '' END || chr(10) || '}}' AS body FROM p
  UNION ALL SELECT *, 'method', 1, name, {_MADE} FROM p WHERE place = 1 AND is_class UNION ALL SELECT *, 'method', 2, 'find', 'public List<String> find(int a, String b) {{ return null; }}' FROM p WHERE place = 1 AND is_class
  UNION ALL SELECT *, 'method', 3, 'plain', 'void plain() {{ }}' FROM p WHERE place = 1 AND is_class UNION ALL SELECT *, 'method', 1, 'findByName', 'List<' || e || '> findByName(String name);' FROM p WHERE place = 1 AND NOT is_class
  UNION ALL SELECT *, 'method', 1, 'go', 'void go(' || name || ' x);' FROM p WHERE place = 3 AND kind = 'interface'
  UNION ALL SELECT p.*, 'method_part', CAST(4000 + i AS INT), 'big', piece FROM p, (SELECT i, trim(string_agg(CASE j WHEN 0 THEN 'public int big() {{' WHEN 151 THEN '        return total; }}' ELSE '        total = total + 1;' END, chr(10) ORDER BY j)) AS piece
    FROM (SELECT i, unnest(range(lo, hi + 1)) AS j FROM (VALUES {', '.join(map(str, _PARTS))}) v(i, lo, hi)) GROUP BY i) WHERE place = 1 AND is_class AND k % 9 = 0)
SELECT md5(file_path || chunk_type || chunk_index) AS chunk_id, file_path, package, id AS class_name, annotations, method, chunk_type, chunk_index, md5(CASE WHEN chunk_type = 'class_summary' THEN head || body ELSE head || body END) AS content FROM bodies"""


@catalog.add(_CHUNKS)
def java_chunks(spark, sf):
    return chunking.chunk_files(parsed(spark, sf)).select("chunk_id", "file_path", "package", "class_name", "annotations", "method", "chunk_type", "chunk_index", F.md5("page_content").alias("content"))


def drops(spark, sf):
    """Three drops of the files: all, every tenth in an older version; those as they are now; every seventh gone."""
    rows = java_files(spark, sf).withColumn("k", F.regexp_extract("file_path", r"/P([0-9]+)[^/]*$", 1).cast("long"))
    drop = lambda rows, content, version: rows.select("file_path", content.alias("content"), F.lit(version).cast("long").alias("version"), F.lit("2026-01-01").cast("timestamp").alias("dropped"))
    older = F.lit("package com.old;\nclass Old { void old() { } }\n").cast("binary")
    return (
        drop(rows, F.when(F.col("k") % 10 == 0, older).otherwise(F.col("content")), 1),
        drop(rows.where("k % 10 = 0"), F.col("content"), 2),
        drop(rows.where("k % 7 = 0"), F.lit(None).cast("binary"), 3),
    )


@catalog.add(_CHUNKS + " WHERE file_path IN (SELECT file_path FROM f WHERE k % 7 <> 0)")
def java_chunk_upsert(spark, sf):
    """The index after new, changed and deleted files came in three batches."""
    index = ChunkIndex(spark, work_folder(spark, "index"))
    for drop in drops(spark, sf):
        index.take(drop)
    return index.chunks.read().select("chunk_id", "file_path", "package", "class_name", "annotations", "method", "chunk_type", "chunk_index", F.md5("page_content").alias("content"))


@catalog.add(_FILES + f""", n AS (SELECT file_path, count(*) AS chunks FROM ({_CHUNKS}) GROUP BY file_path)
SELECT s.file_path, CASE WHEN k % 7 = 0 THEN '' ELSE md5(source) END AS content_hash, CAST(CASE WHEN k % 7 = 0 THEN 3 WHEN k % 10 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version, coalesce(CASE WHEN k % 7 <> 0 THEN chunks END, 0) AS chunks FROM s{len(STEPS)} s LEFT JOIN n ON n.file_path = s.file_path""")
def stream_java_ingest(spark, sf):
    """The same drops as a stream that repeats the first one at its end: the version that each file is of, and how many chunks it has."""
    folder = work_folder(spark, "ingest")
    first, *rest = drops(spark, sf)
    for number, drop in enumerate((first, *rest, first)):
        drop.coalesce(1).write.parquet(f"{folder}/drops/{number}")
    index = ingest(spark, f"{folder}/drops", folder, per_batch=1)
    counts = index.chunks.read().groupBy("file_path").agg(F.count("*").alias("chunks"))
    return index.files.read().join(counts, "file_path", "left").na.fill(0, ["chunks"])


@catalog.add(_FILES + " SELECT file_path, 'List find(2)' AS signature FROM f WHERE is_class UNION ALL SELECT file_path, 'int big(0)' FROM f WHERE is_class AND k % 9 = 0")
def java_signatures(spark, sf):
    return rules.signatures(parsed(spark, sf), "file_path", "source")


# In a file, every class is held to implement what the text says; the classes of a file are its own and a test's.
_OWN = _FILES + ", c AS (SELECT f.k, file_path, id AS class_name FROM f JOIN t USING (k, file_path) WHERE kind = 'class')"


@catalog.add(_OWN + " SELECT iface, class_name, file_path FROM c, (VALUES ('Runnable'), ('Comparable')) v(iface)")
def java_implementors(spark, sf):
    return rules.implementors(parsed(spark, sf))


@catalog.add(_OWN + """ SELECT 'PAT-005' AS rule_id, 'info' AS severity, 'Strategy pattern: ' || iface || ' has ' || count(*) || ' implementations' AS title FROM c, (VALUES ('Runnable'), ('Comparable')) v(iface) GROUP BY iface HAVING count(*) >= 3""")
def java_strategy_findings(spark, sf):
    return rules.strategy_findings(parsed(spark, sf))


@catalog.add(_FILES + """, s AS (SELECT k, name, file_path, k % 9 = 0 AS big, is_class, k % 8 = 2 AND b || 'Test' <> name AS two, b || 'Test' AS test FROM f),
o AS (SELECT name AS class_name, file_path, big FROM s WHERE is_class UNION ALL SELECT test, file_path, big FROM s WHERE is_class AND two),
l AS (SELECT class_name, max_by(big, file_path) AS big FROM o GROUP BY class_name),
g AS (SELECT 'List find(2)' AS signature, count(*) AS n, md5(string_agg(class_name, ',' ORDER BY class_name)) AS cluster FROM l UNION ALL SELECT 'int big(0)', count(*), md5(string_agg(class_name, ',' ORDER BY class_name)) FROM l WHERE big),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, signature) AS r FROM (SELECT * FROM g WHERE n >= 3 ORDER BY n DESC, signature LIMIT 10)) WHERE r = 1)
SELECT 'DUP-001' AS rule_id, 'low' AS severity, 'Duplicate method signature ''' || signature || ''' in ' || n || ' classes' AS title, n AS classes FROM r""")
def java_duplicate_signatures(spark, sf):
    return rules.duplicate_signatures(parsed(spark, sf))


@catalog.add(_FILES + """, tests AS (SELECT id FROM t WHERE kind = 'class' AND id LIKE '%Test'), u AS (SELECT t.id, t.file_path FROM t JOIN f USING (k, file_path) WHERE f.k % 6 < 2 AND kind = 'class')
SELECT 'DEBT-007' AS rule_id, 'medium' AS severity, 'No test class found for ' || id AS title, file_path FROM u WHERE NOT EXISTS (SELECT 1 FROM tests WHERE contains(tests.id, u.id))""")
def java_missing_tests(spark, sf):
    return rules.missing_tests(parsed(spark, sf))


@catalog.add(_FILES + """, m AS (SELECT f.k, t.id, is_class, f.k % 9 = 0 AS big, f.k % 8 = 0 AS port, f.k % 13 = 0 AS wide FROM f JOIN t USING (k, file_path) WHERE kind = 'class')
SELECT 'SOLID-S003' AS rule_id, 'low' AS severity, 'SRP: ' || id || ' imports from 8 domains' AS title FROM m WHERE wide
UNION ALL SELECT 'ANTI-003', 'low', 'Anemic Domain Model: ' || id || ' has no domain behaviour' FROM m WHERE k % 6 = 3 AND NOT big AND NOT port
UNION ALL SELECT 'MAINT-001', 'low', 'Long methods detected in ' || name || ' (avg ~43 LOC)' FROM f WHERE is_class AND k % 9 = 0 AND k % 8 <> 0""")
def java_metadata_findings(spark, sf):
    return rules.metadata_findings(parsed(spark, sf))


@catalog.add(_FILES + " SELECT count(*) AS files, CAST(sum(CASE WHEN is_class THEN 1 + CAST(k % 8 = 2 AND b || 'Test' <> name AS INT) ELSE 0 END) AS BIGINT) AS classes FROM f")
def java_repository_stats(spark, sf):
    return parsed(spark, sf).agg(F.count("*").alias("files"), F.sum(F.size("classes")).alias("classes"))


@catalog.add(_FILES + " SELECT file_path FROM f WHERE is_class AND (k IN (7, 9) OR (k % 8 = 2 AND b || 'Test' <> name AND b || 'Test' = 'P17HelperTest'))")
def java_target_classes(spark, sf):
    """Files with one of the wanted classes; interfaces do not count."""
    wanted = F.array(F.lit("P7Service"), F.lit("P9Entity"), F.lit("P8Repository"), F.lit("P17HelperTest"))
    return parsed(spark, sf).where(F.arrays_overlap("classes", wanted)).select("file_path")


@catalog.add(_GRAPH + f""" SELECT 'nodes' AS part, id AS key, '{{"package":"' || package || '","class_type":"' || class_type || '","annotations":[' || CASE WHEN annotations = '' THEN '' ELSE '"' || replace(annotations, ',', '","') || '"' END || '],"file_path":"' || file_path || '","color":"' || {_case('class_type', java.NODE_COLORS, '')} || '","id":"' || id || '"}}' AS json FROM nodes
UNION ALL SELECT 'links', src || '>' || dst, '{{"dep_type":"' || dep_type || '","source_file":"' || source_file || '","line":' || line || ',"source":"' || src || '","target":"' || dst || '"}}' FROM edges""")
def java_node_link(spark, sf):
    return reports.node_link_rows(*java.graph(kept(spark, sf)))


@catalog.add(_DEGREES + " SELECT id, ca + ce AS total FROM deg WHERE ca + ce > 0 ORDER BY ca + ce DESC, id LIMIT 12")
def java_top_coupled(spark, sf):
    """The twelve most coupled classes, most coupled first."""
    total = F.col("ca") + F.col("ce")
    return G.degrees(*java.graph(kept(spark, sf))).where(total > 0).orderBy(F.desc(total), "id").limit(12).select("id", total.alias("total"))


@catalog.add(f"WITH {_steps_sql()} SELECT file_path, CASE WHEN k % 50 <> 0 AND k % 37 <> 0 THEN md5(source) ELSE md5('') END AS content, k % 50 <> 0 AND k % 37 <> 0 AS readable FROM s{len(STEPS)}")
def java_contents(spark, sf):
    """Every file's text; an empty one where it cannot be read."""
    files = java_files(spark, sf)
    texts = java.supported(files).where(F.col("file_path").endswith(".java"))
    return java.with_content(files.select("file_path"), texts).select("file_path", F.md5("content").alias("content"), "readable")
