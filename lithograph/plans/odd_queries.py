"""Files that a scan meets besides well-formed classes: without a type, unreadable, badly encoded, unbalanced, very large, with generic fields.

One file for each part, like those of ``java_queries``: a text that both engines can tell from the
part's number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.operators import chunking, rules
from lithograph.plans.tables import Catalog, dealt, table
from lithograph.sources import java, metadata
from lithograph.streaming.events import work_folder

catalog = Catalog()

_PARTS = "(SELECT CAST(p_partkey AS BIGINT) AS k FROM part)"


def parts(spark, sf):
    return dealt(table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k")), "k")


def _parsed(spark, sf, content):
    """One file for each part; ``content`` tells its text from ``k``."""
    return java.parse(parts(spark, sf).select(F.format_string("odd/F%d.java", "k").alias("file_path"), content.cast("binary").alias("content")))


# A line of 49 characters; 30 of them are a window, of which the last four begin the next.
_LINE = "rpad('// note ' || k || ' line ' || i, 48, '.') || '!'"
_WINDOW_SQL = f"""WITH f AS (SELECT k, 10 + k % 90 AS n FROM {_PARTS}), w AS (SELECT k, n, unnest(range(CAST(CASE WHEN n <= 30 THEN 1 ELSE ceil((n - 30) / 26.0) + 1 END AS BIGINT))) AS j FROM f),
l AS (SELECT k, j, unnest(range(j * 26, least(j * 26 + 30, n))) AS i FROM w)
SELECT 'odd/F' || k || '.java' AS file_path, 'fallback' AS chunk_type, CAST(j AS INT) AS chunk_index, md5('odd/F' || k || '.java' || 'fallback' || j) AS chunk_id, md5(string_agg({_LINE}, chr(10) ORDER BY i)) AS content FROM l GROUP BY k, j"""


@catalog.add(_WINDOW_SQL)
def java_fallback_chunks(spark, sf):
    """Files without a type become windows of their text."""
    line = lambda i: F.concat(F.rpad(F.concat(F.lit("// note "), F.col("k").cast("string"), F.lit(" line "), i.cast("string")), 48, "."), F.lit("!"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), 9 + F.col("k") % 90), line), "\n")
    rows = chunking.chunk_files(_parsed(spark, sf, text))
    return rows.select("file_path", "chunk_type", "chunk_index", "chunk_id", F.md5("page_content").alias("content"))


@catalog.add(f"""SELECT 'odd/F' || k || '.java' AS file_path, CASE WHEN k % 5 = 0 THEN 'no content' END AS error, CASE WHEN k % 5 = 0 OR k % 5 = 4 THEN '' ELSE 'F' || k END AS classes,
CASE k % 5 WHEN 0 THEN false ELSE true END AS readable FROM {_PARTS}""")
def java_unreadable(spark, sf):
    """A file without content is told by its error, and bytes that are no text and braces without end do not end a scan; contents are joined so that each file stays."""
    text = F.format_string("package odd;\nclass F%d { int x; }\n", "k")
    content = (
        F.when(F.col("k") % 5 == 1, F.concat(F.lit("// ").cast("binary"), F.unhex(F.lit("FFFEC328")), F.lit("\n").cast("binary"), text.cast("binary")))
        .when(F.col("k") % 5 == 2, F.concat(text, F.lit("class Open { void go() { if (x) {\n")).cast("binary"))
        .when(F.col("k") % 5 == 3, text.cast("binary"))
        .when(F.col("k") % 5 == 4, F.lit("").cast("binary"))
    )
    files = parts(spark, sf).select(F.format_string("odd/F%d.java", "k").alias("file_path"), content.alias("content"))
    kept = java.with_content(files.select("file_path"), files.where("content IS NOT NULL"))
    read = java.parse(files).select("file_path", "error", F.array_join(F.filter("classes", lambda c: c != "Open"), ",").alias("classes"))
    return read.join(kept.select("file_path", "readable"), "file_path")


@catalog.add(f"SELECT CASE WHEN k % 4 <> 0 THEN 'F' || k || '.java' END AS file_path, CASE WHEN k % 4 = 1 THEN 'A,B' ELSE '' END AS classes FROM {_PARTS}")
def metadata_corrupt(spark, sf):
    """Metadata files of which every fourth line is cut off: those rows are null, the others are read."""
    line = F.when(F.col("k") % 4 == 0, '{"file_path": "F').when(F.col("k") % 4 == 1, F.format_string('{"file_path": "F%d.java", "classes": ["A", "B"], "more": 1}', "k")).otherwise(F.format_string('{"file_path": "F%d.java"}', "k"))
    path = work_folder(spark, "corrupt")
    parts(spark, sf).select(line.alias("value")).write.text(path)
    return metadata.load_json(spark, path, "file_path string, classes array<string>").select("file_path", F.coalesce(F.array_join("classes", ","), F.lit("")).alias("classes"))


# Methods and lines of a large class.
_METHODS, _FILLER = "k % 41", "k % 9 * 110"
_LARGE = f"WITH c AS (SELECT 'F' || k AS name, {_METHODS} AS methods, 4 + {_METHODS} + {_FILLER} AS loc FROM {_PARTS})"


@catalog.add(_LARGE + """ SELECT 'SOLID-S001' AS rule_id, 'medium' AS severity, 'SRP: ' || name || ' has too many methods (' || methods || ')' AS title FROM c WHERE methods > 15
UNION ALL SELECT 'SOLID-S002', CASE WHEN loc > 500 THEN 'medium' ELSE 'low' END, 'SRP: ' || name || ' is too large (' || loc || ' LOC)' FROM c WHERE loc > 300
UNION ALL SELECT 'MAINT-001', 'low', 'Long methods detected in ' || name || ' (avg ~' || printf('%.0f', round_even(loc / CAST(methods AS DOUBLE), 0)) || ' LOC)' FROM c WHERE methods > 0 AND loc / CAST(methods AS DOUBLE) > 40
UNION ALL SELECT 'ANTI-001', CASE WHEN loc > 800 OR methods > 30 THEN 'high' ELSE 'medium' END, 'God Class anti-pattern: ' || name || ' (' || loc || ' LOC, ' || methods || ' methods)' FROM c WHERE loc >= 500 OR methods >= 20""")
def java_size_findings(spark, sf):
    """Rules on the size of a class, over classes of 0 to 40 methods and 4 to 924 lines."""
    methods = F.array_join(F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.expr(_METHODS)), lambda i: i < F.expr(_METHODS)), lambda i: F.concat(F.lit("  void act"), i.cast("string"), F.lit("() { }\n"))), "")
    text = F.concat(F.lit("package odd;\n"), F.format_string("public class F%d {\n", "k"), methods, F.repeat(F.lit("  // filler\n"), F.expr(_FILLER).cast("int")), F.lit("}\n"))
    return rules.metadata_findings(_parsed(spark, sf, text)).select("rule_id", "severity", "title")


@catalog.add(f"""WITH p AS (SELECT k, 'F' || k AS src, 'odd/F' || k || '.java' AS source_file FROM {_PARTS})
SELECT src, 'L' || k AS dst, 'field_injection' AS dep_type, source_file, 3 AS line FROM p UNION ALL SELECT src, 'M' || k, 'field_injection', source_file, 4 FROM p
UNION ALL SELECT src, 'C' || k, 'constructor_injection', source_file, 8 FROM p UNION ALL SELECT 'Second', 'D' || k, 'constructor_injection', source_file, 11 FROM p""")
def java_generic_edges(spark, sf):
    """Injected fields of generic types tell their first argument; arrays, dotted names, primitive and plain fields tell nothing; each type of a file has edges of its own."""
    k = F.col("k").cast("string")
    text = F.concat(
        F.lit("package odd;\nclass F"), k, F.lit(" {\n  @Autowired private List<L"), k, F.lit("> all;\n  @Inject M"), k, F.lit(" one;\n  @Autowired private P[] many;\n  @Autowired a.b.Q dotted;\n  @Value(\"x\") private int n; private Z plain;\n  F"), k,
        F.lit("(C"), k, F.lit(" c, List<X> xs, int n) { }\n}\nclass Second {\n  Second(D"), k, F.lit(" d) { }\n}\n"),
    )
    return java.edges(_parsed(spark, sf, text)).select("src", "dst", "dep_type", "source_file", "line")
