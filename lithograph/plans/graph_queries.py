"""Dependency-graph queries over the nation trade graph.

Edges: for each supplier nation the two customer nations with most line items (ties to the
smaller key), other than itself.  Regions play packages, and region keys layers.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.storage import cut
from lithograph.operators import graph
from lithograph.operators.relational import keep_best, top_per_group
from lithograph.plans.tables import Catalog, table

catalog = Catalog()

EDGES = """WITH RECURSIVE flow AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE s_nationkey <> c_nationkey GROUP BY ALL),
edges AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS k FROM flow) WHERE k <= 2),
nodes AS (SELECT n_nationkey AS id, n_regionkey AS region FROM nation)"""

_DEGREES = EDGES + """,
deg AS (SELECT id, coalesce(a.n, 0) AS ca, coalesce(e.n, 0) AS ce FROM nodes
  LEFT JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY dst) a ON a.dst = id
  LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) e ON e.src = id)"""


def nodes(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))


def edges(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    supplier = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    flow = (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )
    return top_per_group(flow, ["src"], [F.desc("n"), F.col("dst")], 2).select("src", "dst")


@catalog.add(EDGES + " SELECT src, dst FROM edges")
def graph_edges(spark, sf):
    return graph.build_edges(edges(spark, sf), nodes(spark, sf))


@catalog.add(_DEGREES + " SELECT id, ca, ce, round(CASE WHEN ca + ce = 0 THEN 0.0 ELSE CAST(ce AS DOUBLE) / (ca + ce) END, 3) AS instability, ca + ce > 4 AS highly_coupled FROM deg")
def graph_degree_coupling(spark, sf):
    return graph.degrees(nodes(spark, sf), edges(spark, sf))


@catalog.add(_DEGREES + " SELECT id, ca + ce AS total FROM deg WHERE ca + ce > 4")
def graph_highly_coupled(spark, sf):
    return graph.degrees(nodes(spark, sf), edges(spark, sf)).where("highly_coupled").select("id", (F.col("ca") + F.col("ce")).alias("total"))


@catalog.add(EDGES + " SELECT id FROM nodes WHERE id NOT IN (SELECT dst FROM edges)")
def graph_orphans(spark, sf):
    """Nodes that nothing depends on (the trade graph has no node without any edge)."""
    entry = edges(spark, sf).select("dst", F.col("dst").alias("src"))
    return graph.orphans(nodes(spark, sf), entry)


_REACH = EDGES + """,
reach(root, id) AS (SELECT src, dst FROM edges UNION SELECT root, dst FROM reach JOIN edges ON src = id)"""

_WCC = EDGES + """,
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
conn(a, b) AS (SELECT id, id FROM nodes UNION SELECT conn.a, both_ways.b FROM conn JOIN both_ways ON conn.b = both_ways.a),
reach(root, id) AS (SELECT src, dst FROM edges UNION SELECT root, dst FROM reach JOIN edges ON src = id)"""


@catalog.add(_WCC + """
SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges,
  round((SELECT count(*) FROM edges) / CAST((SELECT count(*) * (count(*) - 1) FROM nodes) AS DOUBLE), 4) AS density,
  NOT EXISTS (SELECT 1 FROM reach WHERE root = id) AS is_dag,
  (SELECT count(DISTINCT m) FROM (SELECT min(b) AS m FROM conn GROUP BY a)) AS n_components""")
def graph_stats(spark, sf):
    return graph.stats(nodes(spark, sf), cut(edges(spark, sf)))


@catalog.add(_WCC + " SELECT a AS id, min(b) AS component FROM conn GROUP BY a")
def graph_weak_components(spark, sf):
    return graph.weak_components(nodes(spark, sf), cut(edges(spark, sf)))


@catalog.add(_REACH + """ SELECT DISTINCT root AS id, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = root AND e.dst = 7) THEN 'direct' ELSE 'transitive' END AS relationship
FROM reach WHERE id = 7 AND root <> 7""")
def graph_dependents_closure(spark, sf):
    return graph.closure(cut(graph.reversed_edges(edges(spark, sf))), 7)


@catalog.add(_REACH + """ SELECT DISTINCT id, CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = 3 AND e.dst = reach.id) THEN 'direct' ELSE 'transitive' END AS relationship
FROM reach WHERE root = 3 AND id <> 3""")
def graph_dependencies_closure(spark, sf):
    return graph.closure(cut(edges(spark, sf)), 3)


@catalog.add(EDGES + " SELECT src AS id, n_name AS name FROM edges JOIN nation ON n_nationkey = src WHERE dst = 7")
def graph_direct_dependents(spark, sf):
    named = table(spark, sf, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("name"))
    return edges(spark, sf).where("dst = 7").join(named, "src").select(F.col("src").alias("id"), "name")


_PATHS = EDGES + """,
walk(here, path) AS (SELECT dst, [src, dst] FROM edges WHERE src = 3
  UNION ALL SELECT dst, list_append(path, dst) FROM walk JOIN edges ON src = here WHERE here <> 7 AND NOT list_contains(path, dst) AND len(path) <= 5)"""


def _paths(spark, sf):
    return graph.simple_paths(cut(edges(spark, sf)), 3, 7, 5)


@catalog.add(_PATHS + " SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS length FROM walk WHERE here = 7 AND len(path) <= 6")
def graph_all_paths_cutoff(spark, sf):
    return _paths(spark, sf).select(F.array_join("path", ">").alias("path"), "length")


@catalog.add(_PATHS.replace("len(path) <= 5", "len(path) <= 10") + " SELECT array_to_string(path, '>') AS path, CAST(len(path) - 1 AS INT) AS length FROM walk WHERE here = 7")
def graph_all_paths_10(spark, sf):
    return graph.simple_paths(cut(edges(spark, sf)), 3, 7, 10).select(F.array_join("path", ">").alias("path"), "length")


@catalog.add(_PATHS + " SELECT array_to_string(p, '>') AS path, CAST(len(p) - 1 AS INT) AS length FROM (SELECT path AS p FROM walk WHERE here = 7 ORDER BY len(path), path LIMIT 1) t")
def graph_shortest_path(spark, sf):
    return graph.shortest_path(cut(edges(spark, sf)), 3, 7, 5).select(F.array_join("path", ">").alias("path"), "length")


@catalog.add(_PATHS + """ , best AS (SELECT path FROM walk WHERE here = 7 ORDER BY len(path), path LIMIT 1),
step AS (SELECT unnest(path) AS id, generate_subscripts(path, 1) AS k FROM best)
SELECT coalesce(string_agg(n_name || ' (' || n_regionkey || ')', ' --[trade]--> ' ORDER BY k), '') AS chain FROM step JOIN nation ON n_nationkey = id""")
def graph_chain_text(spark, sf):
    path = graph.shortest_path(cut(edges(spark, sf)), 3, 7, 5).select(F.posexplode("path").alias("k", "id"))
    named = path.join(table(spark, sf, "nation"), F.col("id") == F.col("n_nationkey"))
    text = F.concat("n_name", F.lit(" ("), "n_regionkey", F.lit(")"))
    return named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", text.alias("t")))), lambda s: s["t"]), " --[trade]--> ").alias("chain"))


@catalog.add(EDGES + """,
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
one AS (SELECT 7 AS id UNION SELECT b FROM both_ways WHERE a = 7),
near AS (SELECT id FROM one UNION SELECT b FROM both_ways WHERE a IN (SELECT id FROM one))
SELECT src, dst FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near)""")
def graph_ego_2hop(spark, sf):
    return graph.ego_graph(cut(edges(spark, sf)), 7, 2)


@catalog.add(EDGES + """,
walk(root, here, path) AS (SELECT src, dst, [src, dst] FROM edges WHERE src < dst
  UNION ALL SELECT root, dst, list_append(path, dst) FROM walk JOIN edges ON src = here WHERE dst > root AND NOT list_contains(path, dst) AND len(path) <= 4)
SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INT) AS length FROM walk JOIN edges ON src = here AND dst = root""")
def graph_cycles_len5(spark, sf):
    return graph.cycles(cut(edges(spark, sf)), 5).select(F.array_join("path", ">").alias("path"), "length")


@catalog.add(EDGES + """ SELECT src, dst, s.region AS src_rank, d.region AS dst_rank FROM edges JOIN nodes s ON s.id = src JOIN nodes d ON d.id = dst
WHERE s.region > 0 AND d.region > 0 AND s.region < d.region""")
def graph_layer_violations(spark, sf):
    return graph.layer_violations(edges(spark, sf), nodes(spark, sf).withColumnRenamed("region", "rank"))


@catalog.add(_DEGREES + " SELECT id, ca AS degree FROM deg ORDER BY ca DESC, id LIMIT 5")
def graph_top_indegree(spark, sf):
    return graph.top_by_degree(nodes(spark, sf), edges(spark, sf), "dst", 5)


@catalog.add(_DEGREES + " SELECT id, ce AS degree FROM deg ORDER BY ce DESC, id LIMIT 5")
def graph_top_outdegree(spark, sf):
    return graph.top_by_degree(nodes(spark, sf), edges(spark, sf), "src", 5)


@catalog.add(_DEGREES + """ SELECT d.region AS layer, count(*) AS members, (SELECT count(*) FROM edges JOIN nodes s ON s.id = src JOIN nodes t ON t.id = dst WHERE t.region = d.region AND s.region <> d.region) AS edges_in,
(SELECT count(*) FROM edges JOIN nodes s ON s.id = src WHERE s.region = d.region) AS edges_out FROM nodes d GROUP BY d.region""")
def graph_layer_edge_counts(spark, sf):
    """Per layer: edges that enter it from another layer, and all edges that leave its members."""
    n = nodes(spark, sf)
    both = edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("region").alias("from_layer")), "src").join(n.select(F.col("id").alias("dst"), F.col("region").alias("to_layer")), "dst")
    enter = both.where("from_layer <> to_layer").groupBy(F.col("to_layer").alias("layer")).agg(F.count("*").alias("edges_in"))
    leave = both.groupBy(F.col("from_layer").alias("layer")).agg(F.count("*").alias("edges_out"))
    return n.groupBy(F.col("region").alias("layer")).agg(F.count("*").alias("members")).join(enter, "layer", "left").join(leave, "layer", "left").na.fill(0)


@catalog.add(EDGES + """ SELECT '{"nodes":[' || (SELECT string_agg('{"id":' || id || ',"group":' || region || '}', ',' ORDER BY id) FROM nodes) || '],"links":['
|| (SELECT string_agg('{"source":' || src || ',"target":' || dst || '}', ',' ORDER BY src, dst) FROM edges) || ']}' AS json""")
def graph_node_link_json(spark, sf):
    n = nodes(spark, sf).agg(F.array_sort(F.collect_list(F.struct("id", F.col("region").alias("group")))).alias("nodes"))
    e = edges(spark, sf).agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("links"))
    return n.crossJoin(e).select(F.to_json(F.struct("nodes", "links")).alias("json"))


@catalog.add(EDGES + """ SELECT 'digraph G {' || chr(10) || (SELECT string_agg('  "' || n_name || '" [group=' || n_regionkey || '];', chr(10) ORDER BY n_name) FROM nation)
|| chr(10) || (SELECT string_agg('  "' || s.n_name || '" -> "' || d.n_name || '";', chr(10) ORDER BY s.n_name, d.n_name) FROM edges JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst) || chr(10) || '}' AS dot""")
def graph_dot(spark, sf):
    nation = table(spark, sf, "nation")
    lines = nation.select(F.col("n_name").alias("a"), F.format_string('  "%s" [group=%d];', "n_name", "n_regionkey").alias("line")).agg(F.array_sort(F.collect_list(F.struct("a", "line"))).alias("nodes"))
    src = nation.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("a"))
    dst = nation.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("b"))
    arrows = edges(spark, sf).join(src, "src").join(dst, "dst").agg(F.array_sort(F.collect_list(F.struct("a", "b", F.format_string('  "%s" -> "%s";', "a", "b").alias("line")))).alias("links"))
    text = lambda c: F.array_join(F.transform(c, lambda s: s["line"]), "\n")
    return lines.crossJoin(arrows).select(F.concat(F.lit("digraph G {\n"), text("nodes"), F.lit("\n"), text("links"), F.lit("\n}")).alias("dot"))


@catalog.add("""SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderkey FROM (
SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS k FROM orders) WHERE k = 1""")
def edge_dedup_priority(spark, sf):
    """Of parallel (customer, status) edges the one with the strongest priority, then the first."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_orderkey")
    return keep_best(rows, ["o_custkey", "o_orderstatus"], [F.col("o_orderpriority"), F.col("o_orderkey")])


@catalog.add("""SELECT o_custkey AS src, o_orderstatus AS dst, min(o_orderkey) AS first_seen, arg_min(o_totalprice, o_orderpriority || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS best_price
FROM orders GROUP BY o_custkey, o_orderstatus""")
def edge_merge_keep_best(spark, sf):
    """Merged edges: attributes of the strongest, origin of the first."""
    rows = table(spark, sf, "orders")
    return rows.groupBy(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst")).agg(F.min("o_orderkey").alias("first_seen"), F.min_by("o_totalprice", F.struct("o_orderpriority", "o_orderkey")).alias("best_price"))


@catalog.add("SELECT p_partkey, p_type FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def nodes_by_type(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    first = part.agg(F.min("p_type").alias("p_type"))
    return part.join(F.broadcast(first), "p_type", "left_semi").select("p_partkey", "p_type")


@catalog.add("SELECT c_custkey, c_name FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def nodes_by_prefix(spark, sf):
    return table(spark, sf, "customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name")
