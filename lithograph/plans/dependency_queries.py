"""Components, closures, paths and cycles over graphs that are read from generated Java files.

Two graphs.  That of ``java_queries``: a class for each part, most of them in one large strong
component, so its cycles are asked for up to a length.  And layered sources, a class for each
part too: groups of 16 classes that import forward only, except that every third group holds
a ring of 8 to 12 classes with chords; there all cycles are asked for, of any length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.functions.order import numbered
from lithograph.functions.storage import cut
from lithograph.operators import graph
from lithograph.operators import questions as Q
from lithograph.plans import java_queries as J
from lithograph.plans.tables import Catalog, dealt, table
from lithograph.sources import java

catalog = Catalog()

#: Layered sources: place in the group ``o``, group ``g``, and the offsets that a class imports (null: none), the same text for both engines.
RING = "g % 3 = 0"
IMPORTS = {
    "next": f"CASE WHEN {RING} AND o < 7 + g % 5 THEN o + 1 WHEN {RING} AND o = 7 + g % 5 THEN 0 WHEN NOT ({RING}) AND o % 4 < 3 THEN o + 1 END",
    "chord": f"CASE WHEN {RING} AND o = 2 THEN 5 WHEN {RING} AND o = 6 THEN 1 WHEN NOT ({RING}) AND o < 8 THEN o + 8 END",
    "across": "CASE WHEN o = 3 AND g % 4 < 3 THEN 16 WHEN o = 15 AND g % 4 < 2 THEN 33 END",
}


def layered_files(spark, sf):
    """(file_path, content) of a class for each part that imports the classes at its offsets, counted from its group's first."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"))
    rows = dealt(part, "k").selectExpr("k", "k div 16 AS g", "k % 16 AS o").selectExpr("*", *(f"{e} AS {c}" for c, e in IMPORTS.items()))
    line = lambda c: F.when(F.col(c).isNotNull(), F.format_string("import com.layers.g%d.L%d;\n", F.expr(f"(g * 16 + {c}) div 16"), F.expr(f"g * 16 + {c}"))).otherwise("")
    source = F.concat(F.format_string("package com.layers.g%d;\n", "g"), *map(line, IMPORTS), F.format_string("// import com.layers.g0.L0;\npublic class L%d { String s = \"import com.layers.g0.L1;\"; }\n", "k"))
    return rows.select(F.format_string("src/com/layers/g%d/L%d.java", "g", "k").alias("file_path"), source.cast("binary").alias("content"))


def layered(spark, sf):
    """(nodes, edges) of the layered sources, as the scanner reads them."""
    nodes, edges = java.graph(cut(java.parse(layered_files(spark, sf))))
    return cut(nodes.select("id")), cut(edges.select("src", "dst"))


def _edges(spark, sf):
    nodes, edges = java.graph(J.kept(spark, sf))
    return nodes, cut(edges.select("src", "dst"))


_LAYERS = "WITH RECURSIVE s AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_partkey AS BIGINT) // 16 AS g, CAST(p_partkey AS BIGINT) % 16 AS o FROM part), e AS (" + " UNION ".join(f"SELECT 'L' || k AS src, 'L' || (g * 16 + {e}) AS dst, g, {RING} AND g * 16 + {e} < g * 16 + 16 AS ring FROM s WHERE {e} IS NOT NULL AND g * 16 + {e} IN (SELECT k FROM s)" for e in IMPORTS.values()) + ")"
# A cycle cannot leave its group: imports to other groups go forward.
_LAYER_CYCLES = _LAYERS + """, walk(root, here, path) AS (SELECT src, dst, [src, dst] FROM e WHERE ring AND src < dst
  UNION ALL SELECT root, e.dst, list_append(path, e.dst) FROM walk JOIN e ON e.src = here AND ring WHERE e.dst > root AND NOT list_contains(path, e.dst)),
cyc AS (SELECT path FROM walk JOIN e ON e.src = here AND e.dst = root)"""


@catalog.add(_LAYER_CYCLES + " SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INT) AS length, CAST(row_number() OVER (ORDER BY len(path), array_to_string(path, '>')) AS BIGINT) AS place FROM cyc")
def layered_cycles(spark, sf):
    """Every elementary cycle of any length, shortest first."""
    _, edges = layered(spark, sf)
    return numbered(graph.cycles(edges).select(F.array_join("path", ">").alias("path"), "length"), [F.col("length"), F.col("path")])


@catalog.add(_LAYERS + """, reach(a, b) AS (SELECT src, dst FROM e WHERE ring UNION SELECT a, e.dst FROM reach JOIN e ON e.src = b AND ring)
SELECT 'L' || k AS id, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = 'L' || k), 'L' || k) AS component FROM s""")
def layered_components(spark, sf):
    """Strong components; the classes of no ring are components of their own."""
    return graph.strong_components(*layered(spark, sf))


@catalog.add(_LAYER_CYCLES + """, deg AS (SELECT 'L' || k AS id, (SELECT count(*) FROM e WHERE dst = 'L' || k) AS ca, (SELECT count(*) FROM e WHERE src = 'L' || k) AS ce FROM s)
SELECT unnest(['00', '01', '02', '03', '04']) AS key, unnest(['  Classes analysed     : ' || (SELECT count(*) FROM s), '  Circular deps        : ' || (SELECT count(*) FROM cyc), '  Orphan classes       : ' || (SELECT count(*) FROM deg WHERE ca + ce = 0),
  '  Highly coupled       : ' || (SELECT count(*) FROM deg WHERE ca + ce > 4), '  Layer violations     : ' || (SELECT count(*) FROM e WHERE src LIKE '%5' AND dst LIKE '%6')]) AS line
UNION ALL SELECT '1-' || lpad(CAST(1000000000 - ca - ce AS VARCHAR), 10, '0') || '-' || id, '    ' || rpad(id, 35, ' ') || ' Ca=' || ca || '  Ce=' || ce || '  I=' || printf('%.2f', round(CAST(ce AS DOUBLE) / (ca + ce), 3)) FROM deg WHERE ca + ce > 4
UNION ALL SELECT '2-' || id, '    ' || id FROM deg WHERE ca + ce = 0 UNION ALL SELECT '3-' || src || '>' || dst, '    ' || src || ' -> ' || dst FROM e WHERE src LIKE '%5' AND dst LIKE '%6'""")
def layered_report(spark, sf):
    """The structural report with every cycle; classes whose number ends in 6 are above those that end in 5."""
    nodes, edges = layered(spark, sf)
    rank = F.when(F.col("id").endswith("5"), 1).when(F.col("id").endswith("6"), 2).otherwise(0)
    return Q.report_lines(Q.report(nodes, edges, nodes.select("id", rank.alias("rank"))))


_REACH = J._GRAPH.replace("WITH ", "WITH RECURSIVE ", 1)


@catalog.add(_REACH + """, reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT a, dst FROM reach JOIN edges ON src = b)
SELECT id, coalesce(least(id, (SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = id)), id) AS component FROM nodes""")
def java_strong_components(spark, sf):
    nodes, edges = _edges(spark, sf)
    return graph.strong_components(nodes, edges)


_FROM, _TO = "P7Service", "P10Config"


def _closure(seed: str, near: str, far: str) -> str:
    return _REACH + f", reach(id) AS (SELECT '{seed}' UNION SELECT {far} FROM reach JOIN edges ON {near} = id) SELECT id, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.{near} = '{seed}' AND e.{far} = reach.id) THEN 'direct' ELSE 'transitive' END AS relationship FROM reach WHERE id <> '{seed}'"


@catalog.add(_closure(_FROM, "src", "dst"))
def java_dependencies_closure(spark, sf):
    return graph.closure(_edges(spark, sf)[1], _FROM)


@catalog.add(_closure(_TO, "dst", "src"))
def java_dependents_closure(spark, sf):
    return graph.closure(graph.reversed_edges(_edges(spark, sf)[1]), _TO)


_WALKS = _REACH + f""", walk(here, path) AS (SELECT dst, [src, dst] FROM edges WHERE src = '{_FROM}'
  UNION ALL SELECT dst, list_append(path, dst) FROM walk JOIN edges ON src = here WHERE here <> '{_TO}' AND NOT list_contains(path, dst) AND len(path) <= 10), hits AS (SELECT path FROM walk WHERE here = '{_TO}')"""


@catalog.add(_WALKS + " SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS length FROM hits")
def java_all_paths_10(spark, sf):
    return graph.simple_paths(_edges(spark, sf)[1], _FROM, _TO, 10).select(F.array_join("path", ">").alias("path"), "length")


@catalog.add(_WALKS + " SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS length FROM (SELECT path FROM hits ORDER BY len(path), path LIMIT 1)")
def java_shortest_path(spark, sf):
    return graph.shortest_path(_edges(spark, sf)[1], _FROM, _TO, 10).select(F.array_join("path", ">").alias("path"), "length")


@catalog.add(_REACH + """, walk(root, here, path) AS (SELECT src, dst, [src, dst] FROM edges WHERE src < dst
  UNION ALL SELECT root, dst, list_append(path, dst) FROM walk JOIN edges ON src = here WHERE dst > root AND NOT list_contains(path, dst) AND len(path) <= 5)
SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INT) AS length FROM walk JOIN edges ON src = here AND dst = root""")
def java_cycles_len6(spark, sf):
    """Cycles of up to 6 classes: most classes are in one component, whose longer cycles no engine can list."""
    return graph.cycles(_edges(spark, sf)[1], 6).select(F.array_join("path", ">").alias("path"), "length")


@catalog.add(_REACH + f""", both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
one AS (SELECT '{_FROM}' AS id UNION SELECT b FROM both_ways WHERE a = '{_FROM}'), near AS (SELECT id FROM one UNION SELECT b FROM both_ways WHERE a IN (SELECT id FROM one))
SELECT src, dst FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""")
def java_ego_2hop(spark, sf):
    return graph.ego_graph(_edges(spark, sf)[1], _FROM, 2)


@catalog.add(_REACH + """, both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), conn(a, b) AS (SELECT id, id FROM nodes UNION SELECT conn.a, both_ways.b FROM conn JOIN both_ways ON conn.b = both_ways.a)
SELECT a AS id, min(b) AS component FROM conn GROUP BY a""")
def java_weak_components(spark, sf):
    nodes, edges = _edges(spark, sf)
    return graph.weak_components(nodes, edges)
