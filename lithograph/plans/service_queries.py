"""Named questions, access and updates, files of metadata and results, retrieval contexts, routing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.functions.order import numbered
from lithograph.functions.storage import cut, saved
from lithograph.operators import chunking
from lithograph.operators import questions as Q
from lithograph.operators import relational as R
from lithograph.operators import retrieval as T
from lithograph.operators import rules, structure
from lithograph.plans import graph_queries as G
from lithograph.plans import java_queries as J
from lithograph.plans import text_queries as X
from lithograph.plans.tables import Catalog, table
from lithograph.sources import java, metadata
from lithograph.streaming.events import work_folder

catalog = Catalog()


def _trade(spark, sf):
    """The trade graph as a dependency graph: nations are classes, regions packages, priorities of trade types."""
    nation = table(spark, sf, "nation")
    nodes = nation.select(F.col("n_name").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("package"), F.concat(F.lit("t"), F.col("n_regionkey") % 3).alias("class_type"))
    src = nation.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("a"))
    dst = nation.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("b"))
    named = G.edges(spark, sf).join(src, "src").join(dst, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.when(F.length("a") % 2 == 0, "import").otherwise("field_injection").alias("dep_type"))
    return cut(nodes), cut(named)


_TRADE = G.EDGES.replace("edges AS (SELECT src, dst FROM (", "number_edges AS (SELECT src, dst FROM (") + """,
n AS (SELECT n_name AS id, 'r' || n_regionkey AS package, 't' || (n_regionkey % 3) AS class_type FROM nation),
e AS (SELECT s.n_name AS src, d.n_name AS dst, CASE WHEN length(s.n_name) % 2 = 0 THEN 'import' ELSE 'field_injection' END AS dep_type FROM number_edges JOIN nation s ON s.n_nationkey = src JOIN nation d ON d.n_nationkey = dst)"""
_TRADE = _TRADE.replace("FROM flow) WHERE k <= 2),\nnodes AS", "FROM flow) WHERE k <= 2),\nnumber_nodes AS")
_REACH = _TRADE + ", reach(root, id) AS (SELECT src, dst FROM e UNION SELECT root, dst FROM reach JOIN e ON src = id)"

_WHO = """SELECT n.id AS class, package, class_type, CASE WHEN e.src IS NOT NULL THEN 'direct' ELSE 'transitive' END AS relationship, coalesce(e.dep_type, 'transitive') AS dep_type
FROM (SELECT DISTINCT root AS id FROM reach WHERE reach.id = 'NATION_7' AND root <> 'NATION_7') r JOIN n ON n.id = r.id LEFT JOIN e ON e.src = r.id AND e.dst = 'NATION_7'"""
_WHAT = """SELECT n.id AS class, package, class_type, CASE WHEN e.src IS NOT NULL THEN 'direct' ELSE 'transitive' END AS relationship, coalesce(e.dep_type, 'transitive') AS dep_type
FROM (SELECT DISTINCT id FROM reach WHERE root = 'NATION_3' AND id <> 'NATION_3') r JOIN n ON n.id = r.id LEFT JOIN e ON e.src = 'NATION_3' AND e.dst = r.id"""


@catalog.add(_REACH + f" SELECT *, CAST(row_number() OVER (ORDER BY relationship, class) AS BIGINT) AS place FROM ({_WHO})")
def graph_dependents_sorted(spark, sf):
    """All that depend on a node with package, type and kind, numbered by (relationship, class)."""
    nodes, edges = _trade(spark, sf)
    return numbered(Q.related(nodes, edges, "NATION_7", inward=True), [F.col("relationship"), F.col("class")])


_CHAIN = _TRADE + """, walk(here, path) AS (SELECT dst, [src, dst] FROM e WHERE src = 'NATION_3' UNION ALL SELECT dst, list_append(path, dst) FROM walk JOIN e ON src = here WHERE here <> 'NATION_7' AND NOT list_contains(path, dst) AND len(path) <= 6),
best AS (SELECT path FROM walk WHERE here = 'NATION_7' ORDER BY len(path), path LIMIT 1), s AS (SELECT unnest(path) AS class, unnest(list_append(path[2:], NULL)) AS next, unnest(range(len(path))) AS step FROM best)"""


@catalog.add(_CHAIN + " SELECT CAST(step AS INT) AS step, class, package, class_type, dep_type, next FROM s JOIN n ON n.id = class LEFT JOIN e ON e.src = class AND e.dst = next")
def graph_chain_steps(spark, sf):
    return Q.chain(*_trade(spark, sf), "NATION_3", "NATION_7")


@catalog.add(_TRADE + """, walk(root, here, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT root, dst, list_append(path, dst) FROM walk JOIN e ON src = here WHERE dst > root AND NOT list_contains(path, dst))
SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INT) AS length, CAST(row_number() OVER (ORDER BY len(path), array_to_string(path, '>')) AS BIGINT) AS place FROM walk JOIN e ON src = here AND dst = root""")
def graph_cycles_all(spark, sf):
    """Every elementary cycle, shortest first."""
    _, edges = _trade(spark, sf)
    found = Q.G.cycles(edges.select("src", "dst")).select(F.array_join("path", ">").alias("path"), "length")
    return numbered(found, [F.col("length"), F.col("path")])


def _all_answers(spark, sf):
    nodes, edges = _trade(spark, sf)
    wanted = {
        "who_depends_on": {"class_name": "NATION_7"}, "get_dependencies": {"class_name": "NATION_3"}, "dependency_chain": {"source": "NATION_3", "target": "NATION_7"},
        "cycles": {}, "most_depended_on": {}, "orphans": {}, "stats": {}, "by_type": {"class_name": "t1"}, "nonsense": {},
    }
    return {name: (lambda name=name, how=how: Q.ask(nodes, edges, name, **how)) for name, how in wanted.items()}


_DEG = ", deg AS (SELECT n.id, n.class_type, (SELECT count(*) FROM e WHERE dst = n.id) AS ca, (SELECT count(*) FROM e WHERE src = n.id) AS ce FROM n)"


@catalog.add(_REACH + _CHAIN[len(_TRADE):] + _DEG + f""", cyc(root, here, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT root, dst, list_append(path, dst) FROM cyc JOIN e ON src = here WHERE dst > root AND NOT list_contains(path, dst)),
both_ways AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), conn(a, b) AS (SELECT id, id FROM n UNION SELECT conn.a, both_ways.b FROM conn JOIN both_ways ON conn.b = both_ways.a),
st AS (SELECT (SELECT count(*) FROM n) AS nn, (SELECT count(*) FROM e) AS ne, NOT EXISTS (SELECT 1 FROM reach WHERE root = id) AS dag, (SELECT count(DISTINCT m) FROM (SELECT min(b) AS m FROM conn GROUP BY a)) AS parts)
SELECT 'who_depends_on' AS agent, relationship || '-' || class AS key, '  - ' || class || ' (' || class_type || ') [' || relationship || ', ' || dep_type || ']' AS line FROM ({_WHO})
UNION ALL SELECT 'get_dependencies', relationship || '-' || class, '  - ' || class || ' (' || class_type || ') [' || relationship || ']' FROM ({_WHAT})
UNION ALL SELECT 'dependency_chain', '0', string_agg(class || ' (' || class_type || ')' || coalesce(' --[' || dep_type || ']--> ', ''), '' ORDER BY step) FROM s JOIN n ON n.id = class LEFT JOIN e ON e.src = class AND e.dst = next HAVING count(*) > 0
UNION ALL SELECT 'cycles', lpad(CAST(len(path) AS VARCHAR), 4, '0') || '-' || array_to_string(path, '>'), '  - ' || array_to_string(path, ' -> ') || ' -> ' || path[1] FROM cyc JOIN e ON src = here AND dst = root
UNION ALL SELECT 'most_depended_on', lpad(CAST(1000000000 - ca AS VARCHAR), 10, '0') || '-' || id, '  - ' || id || ' (' || class_type || '): ' || ca || ' dependent(s)' FROM (SELECT * FROM deg ORDER BY ca DESC, id LIMIT 10) WHERE ca > 0
UNION ALL SELECT 'orphans', id, '  - ' || id FROM deg WHERE ca + ce = 0
UNION ALL SELECT 'stats', unnest(['0', '1', '2', '3', '4']), unnest(['total_classes: ' || nn, 'total_dependencies: ' || ne, 'is_dag: ' || dag, 'weakly_connected_components: ' || parts, 'density: ' || round(ne / CAST(nn * (nn - 1) AS DOUBLE), 4)]) FROM st
UNION ALL SELECT 'by_type', id, '  - ' || id FROM n WHERE class_type = 't1'
UNION ALL SELECT 'nonsense', '0', 'Unknown query_type: nonsense. Choose from: {", ".join(Q.QUESTIONS)}'""")
def graph_questions(spark, sf):
    """All named questions at once, run side by side."""
    return Q.fan_out(_all_answers(spark, sf))


@catalog.add(_TRADE + _DEG + """, cyc(root, here, path) AS (SELECT src, dst, [src, dst] FROM e WHERE src < dst UNION ALL SELECT root, dst, list_append(path, dst) FROM cyc JOIN e ON src = here WHERE dst > root AND NOT list_contains(path, dst)),
v AS (SELECT src, dst FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.class_type <> 't0' AND b.class_type <> 't0' AND a.class_type < b.class_type)
SELECT unnest(['00', '01', '02', '03', '04']) AS key, unnest(['  Classes analysed     : ' || (SELECT count(*) FROM n), '  Circular deps        : ' || (SELECT count(*) FROM cyc JOIN e ON src = here AND dst = root), '  Orphan classes       : ' || (SELECT count(*) FROM deg WHERE ca + ce = 0),
  '  Highly coupled       : ' || (SELECT count(*) FROM deg WHERE ca + ce > 4), '  Layer violations     : ' || (SELECT count(*) FROM v)]) AS line
UNION ALL SELECT '1-' || lpad(CAST(1000000000 - ca - ce AS VARCHAR), 10, '0') || '-' || id, '    ' || rpad(id, 35, ' ') || ' Ca=' || ca || '  Ce=' || ce || '  I=' || printf('%.2f', round(CAST(ce AS DOUBLE) / (ca + ce), 3)) FROM deg WHERE ca + ce > 4
UNION ALL SELECT '2-' || id, '    ' || id FROM deg WHERE ca + ce = 0 UNION ALL SELECT '3-' || src || '>' || dst, '    ' || src || ' -> ' || dst FROM v""")
def graph_report(spark, sf):
    nodes, edges = _trade(spark, sf)
    ranks = nodes.select("id", F.substring("class_type", 2, 1).cast("int").alias("rank"))
    return Q.report_lines(Q.report(nodes, edges, ranks))


# Access and updates: customers are repositories, owned by nations as users; events are grants.
_USERS = "u AS (SELECT CAST(n_nationkey AS BIGINT) AS user_id, CASE WHEN n_regionkey = 0 THEN 'admin' ELSE 'analyst' END AS role FROM nation), g AS (SELECT CAST(user_id % 25 AS BIGINT) AS user_id, event_id % 1500 + 1 AS id, CASE event_type WHEN 'purchase' THEN 'write' WHEN 'error' THEN 'admin' ELSE 'read' END AS permission FROM events WHERE event_type IN ('purchase', 'error', 'signup'))"


def _access(spark, sf):
    users = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.when(F.col("n_regionkey") == 0, "admin").otherwise("analyst").alias("role"))
    kind = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "error", "admin").otherwise("read")
    grants = table(spark, sf, "events").where("event_type IN ('purchase', 'error', 'signup')").select((F.col("user_id") % 25).cast("long").alias("user_id"), (F.col("event_id") % 1500 + 1).cast("long").alias("id"), kind.alias("permission"))
    repositories = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("owner_id"))
    # Requests: every user asks for its own repositories and those of the next nation, by one equality join.
    wanted = users.withColumn("owner_id", F.explode(F.array("user_id", (F.col("user_id") + 1) % 25)))
    pairs = wanted.join(repositories, "owner_id")
    return pairs, grants


_PAIRS = f"WITH {_USERS}, p AS (SELECT u.user_id, role, c_custkey AS id, c_nationkey AS owner_id FROM u JOIN customer ON c_nationkey = user_id OR c_nationkey = (user_id + 1) % 25)"


@catalog.add(_PAIRS + " SELECT user_id, id FROM p WHERE role = 'admin' OR owner_id = user_id OR EXISTS (SELECT 1 FROM g WHERE g.user_id = p.user_id AND g.id = p.id)")
def access_read(spark, sf):
    pairs, grants = _access(spark, sf)
    return R.may(pairs, grants).select("user_id", "id")


@catalog.add(_PAIRS + " SELECT user_id, id FROM p WHERE role = 'admin' OR owner_id = user_id OR EXISTS (SELECT 1 FROM g WHERE g.user_id = p.user_id AND g.id = p.id AND permission IN ('write', 'admin'))")
def access_write(spark, sf):
    pairs, grants = _access(spark, sf)
    return R.may(pairs, grants, ("write", "admin")).select("user_id", "id")


@catalog.add("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'admin' ELSE c_mktsegment END AS role, c_custkey % 10 <> 3 AS is_active FROM customer")
def user_role_and_deactivate(spark, sf):
    """A role set for one user, and others switched off; nobody is deleted."""
    users = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("role"), F.lit(True).alias("is_active"))
    changed = R.set_where(users, F.col("c_custkey") == 7, role="admin")
    return R.set_where(changed, F.col("c_custkey") % 10 == 3, is_active=False)


@catalog.add("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 11 UNION ALL SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_name = 'Customer#000000012'")
def user_lookup(spark, sf):
    users = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    return R.lookup(users, c_custkey=11).unionByName(R.lookup(users, c_name="Customer#000000012"))


_CHANGES = "c AS (SELECT c_custkey, 'Customer#' || lpad(CAST(c_custkey + c_custkey % 3 AS VARCHAR), 9, '0') AS c_name FROM customer WHERE c_custkey % 5 = 0)"


@catalog.add(f"WITH {_CHANGES} SELECT c.* FROM c WHERE EXISTS (SELECT 1 FROM customer o WHERE o.c_name = c.c_name AND o.c_custkey <> c.c_custkey)")
def update_user_conflicts(spark, sf):
    """Changes to a name that another user has."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name")
    changes = rows.where("c_custkey % 5 = 0").select("c_custkey", F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") + F.col("c_custkey") % 3).cast("string"), 9, "0")).alias("c_name"))
    return R.conflicts(rows, changes, "c_custkey", "c_name")


# Files of metadata and results.
@catalog.add(J._FILES + " SELECT file_path, CASE WHEN is_class THEN name ELSE '' END AS first_class, CASE WHEN NOT is_class THEN 8 WHEN k % 9 = 0 THEN 173 ELSE 22 END AS lines_of_code, 'kept' AS how FROM f UNION ALL SELECT 'none', '', 0, 'missing'")
def metadata_round_trip(spark, sf):
    """Metadata written as JSON and read with its schema; a file that is not there gives no rows to a tolerant reader and an error to a strict one."""
    folder = work_folder(spark, "metadata")
    metadata.save_metadata(J.parsed(spark, sf), folder)
    rows = metadata.load_metadata(spark, folder).select("file_path", F.coalesce(F.get("classes", F.lit(0)), F.lit("")).alias("first_class"), "lines_of_code", F.lit("kept").alias("how"))
    missing = metadata.load_json(spark, f"{folder}-none", metadata.METADATA_SCHEMA).count() + metadata.load_text(spark, f"{folder}-none").count()
    try:
        metadata.load_metadata(spark, f"{folder}-none")
    except FileNotFoundError:
        missing -= 1
    told = spark.createDataFrame([("none", "", 0, "missing" if missing == -1 else "wrong")], "file_path string, first_class string, lines_of_code int, how string")
    return rows.unionByName(told)


@catalog.add(J._FILES + " SELECT unnest(['first', 'second', 'deleted', 'refreshed']) AS step, unnest([false, true, true, false]) AS kept, (SELECT count(*) FROM f) AS files")
def cache_read_through(spark, sf):
    """A result made once, read again, dropped, and made anew."""
    path = work_folder(spark, "cache")
    make = lambda: J.parsed(spark, sf).agg(F.count("*").alias("files"))
    first, kept1 = metadata.read_through(spark, path, make)
    files = first.first().files
    again, kept2 = metadata.read_through(spark, path, make)
    files2 = again.first().files
    gone = metadata.delete(spark, path)
    new, kept3 = metadata.read_through(spark, path, make, refresh=True)
    rows = [("first", kept1, files), ("second", kept2, files2), ("deleted", gone, files), ("refreshed", kept3, new.first().files)]
    return spark.createDataFrame(rows, "step string, kept boolean, files long")


@catalog.add(J._GRAPH + ", c AS (SELECT count(*) AS n FROM (" + J._CHUNKS + ")) SELECT unnest(['METADATA', 'VECTOR_INDEX', 'DEPENDENCY', 'ARCHITECTURE', 'CODE_REVIEW']) AS step, unnest([(SELECT count(*) FROM f), (SELECT n FROM c), (SELECT count(*) FROM edges), (SELECT count(*) FROM t WHERE kind IN ('class', 'interface')), "
    "(SELECT count(*) FROM f WHERE is_class)]) AS rows, 'completed' AS status")
def full_scan(spark, sf):
    """The steps of a full scan, one after the other over what the first wrote; a failed step ends it."""
    folder = work_folder(spark, "scan")
    J.parsed(spark, sf).write.parquet(f"{folder}/files")
    files = spark.read.parquet(f"{folder}/files")
    todo = rules.Rule("DEBT-001", "tech_debt", "low", "Technical debt: {hits} TODO/FIXME/HACK comment(s) in {unit}", r"(?i)//\s*(?:TODO|FIXME|HACK|XXX|BUG|WORKAROUND)[^\n]*")
    steps = {
        "METADATA": lambda: files, "VECTOR_INDEX": lambda: chunking.chunk_files(files), "DEPENDENCY": lambda: java.graph(files)[1],
        "ARCHITECTURE": lambda: structure.detect(files), "CODE_REVIEW": lambda: rules.findings(files, (todo,), "file_path", "source"),
    }
    done = []
    for name, make in steps.items():
        try:
            out = f"{folder}/{name.lower()}"
            make().write.parquet(out)
            done.append((name, spark.read.parquet(out).count(), "completed"))
        except Exception as error:  # noqa: BLE001  a job tells its failure
            done.append((name, 0, f"failed: {type(error).__name__}"))
            break
    return spark.createDataFrame(done, "step string, rows long, status string")


# Retrieval.
_LENGTH = "sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))"


@catalog.add(f"SELECT vec_id, round(embedding[1] / {_LENGTH}, 6) AS first, round(embedding[64] / {_LENGTH}, 6) AS last FROM embeddings")
def vector_normalised(spark, sf):
    unit = T.normalised(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return unit.select("vec_id", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"))


@catalog.add(f"SELECT e.vec_id AS id, round(1.0 / (60 + row_number() OVER (ORDER BY {X._COS} DESC, e.vec_id)), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {X._COS} DESC, e.vec_id LIMIT 8")
def hybrid_dense_only(spark, sf):
    """Vectors alone where there is no document to search."""
    found = T.hybrid(X.documents(spark, sf).limit(0), table(spark, sf, "embeddings"), "no words", X._query_vector(spark, sf))
    return found.select("id", F.round("score", 6).alias("score"))


_RANKED = J._CHUNKS.replace("md5(CASE WHEN chunk_type = 'class_summary' THEN head || body ELSE head || body END) AS content", "head || body AS content")


def _ranked_chunks(spark, sf):
    """Chunks in an order of retrieval: by id of file and place."""
    return chunking.chunk_files(J.parsed(spark, sf)).withColumn("rank", F.conv(F.substring("chunk_id", 1, 8), 16, 10).cast("long"))


@catalog.add(f"WITH c AS ({_RANKED}) SELECT chunk_id, class_name FROM c WHERE contains(lower(class_name), 'p1service') OR contains(lower(regexp_extract(file_path, '[^/]*$')), 'p1service')")
def retrieval_class_filter(spark, sf):
    return T.explain(_ranked_chunks(spark, sf), "P1Service").select("chunk_id", "class_name")


@catalog.add(f"WITH c AS ({_RANKED}) SELECT chunk_id, class_name FROM c ORDER BY ('0x' || chunk_id[1:8])::BIGINT LIMIT 4")
def retrieval_class_fallback(spark, sf):
    """No chunk holds the name: the first four."""
    return T.explain(_ranked_chunks(spark, sf), "NoSuchClass").select("chunk_id", "class_name")


_TOP = f"WITH c AS ({_RANKED}), r AS (SELECT *, CAST(row_number() OVER (ORDER BY chunk_id, class_name) AS BIGINT) AS rank FROM c), l AS (SELECT *, regexp_extract(file_path, '[^/]*$') AS source FROM r)"


@catalog.add(_TOP + """ SELECT rank, source, '--- [' || rank || '] ' || CASE WHEN method IS NOT NULL THEN source || ' >> ' || class_name || '.' || method || '()' ELSE source || ' >> ' || class_name END || ' [' || chunk_type || '] ---' || chr(10) || content AS block FROM l""")
def retrieval_blocks(spark, sf):
    chunks = saved(chunking.chunk_files(J.parsed(spark, sf)).select("chunk_id", "class_name", "file_path", "method", "chunk_type", "page_content"))
    return T.labelled(numbered(chunks, [F.col("chunk_id"), F.col("class_name")], "rank"))


@catalog.add(_TOP + " SELECT source, min(rank) AS rank FROM l GROUP BY source")
def retrieval_sources(spark, sf):
    chunks = saved(chunking.chunk_files(J.parsed(spark, sf)).select("chunk_id", "class_name", T.file_name("file_path").alias("source")))
    return T.sources(numbered(chunks, [F.col("chunk_id"), F.col("class_name")], "rank"))


def _called(words) -> str:
    return " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words)


@catalog.add("WITH q AS (SELECT conv_id, turn, array_to_string(list_filter([" + ", ".join(f"CASE WHEN turn < 8 AND ({_called(words)}) THEN '{name}' END" for name, words in Q.SPECIALISTS.items()) + """], lambda x: x IS NOT NULL), ',') AS agents FROM conversations)
SELECT conv_id, turn, agents, CASE WHEN agents = '' THEN 'synthesize' WHEN contains(agents, ',') THEN 'parallel' ELSE 'one' END AS next FROM q""")
def agent_routes(spark, sf):
    """To which specialists each message goes; after eight rounds to none."""
    routed = Q.route(table(spark, sf, "conversations"), "text", "turn")
    return routed.select("conv_id", "turn", F.array_join("agents", ",").alias("agents"), "next")


_NAMES = "array('search', 'dependency', 'nonsense', 'review', 'docs', 'FINISH', 'search')"


@catalog.add("WITH q AS (SELECT conv_id, turn, list_slice(['search', 'dependency', 'nonsense', 'review', 'docs', 'FINISH', 'search'], 1 + CAST((conv_id + turn) % 6 AS INT), 1 + CAST((conv_id + turn) % 6 AS INT) + CAST(turn % 3 AS INT)) AS names FROM conversations), "
    "k AS (SELECT *, list_filter(list_filter(names, lambda x, i: list_position(names, x) = i), lambda x: list_contains([" + ", ".join(f"'{n}'" for n in Q.SPECIALISTS) + "], x)) AS known FROM q) "
    "SELECT conv_id, turn, CASE WHEN list_contains(names, 'FINISH') OR turn >= 8 THEN '' ELSE array_to_string(known, ',') END AS agents, CASE WHEN list_contains(names, 'FINISH') OR turn >= 8 OR len(known) = 0 THEN 'synthesize' WHEN len(known) = 1 THEN 'one' ELSE 'parallel' END AS next FROM k")
def agent_named_routes(spark, sf):
    """Routing by the names that a coordinator gives, some of them no specialist's."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.expr(f"slice({_NAMES}, 1 + CAST((conv_id + turn) % 6 AS INT), 1 + CAST(turn % 3 AS INT))").alias("next_agents"))
    return Q.named_route(rows, rounds="turn").select("conv_id", "turn", F.array_join("agents", ",").alias("agents"), "next")


_ASKED = "What depends on what?"


@catalog.add("WITH a AS MATERIALIZED (" + catalog.sql["graph_questions"] + f""")
SELECT 0 AS part, '' AS agent, unnest(['000', '001', '002']) AS key, unnest(['Question: {_ASKED}', '', 'Specialist Agent Results:']) AS line UNION ALL SELECT 2, '', unnest(['000', '001']), unnest(['', 'Synthesize a complete, grounded answer:'])
UNION ALL SELECT DISTINCT 1, agent, '', '--- ' || upper(agent) || ' AGENT ---' FROM a UNION ALL SELECT 1, agent, '-' || key, line[1:1500] FROM a""")
def agent_synthesis(spark, sf):
    """The answers of all specialists, run side by side, put together for the last step."""
    return Q.synthesis(_ASKED, Q.fan_out(_all_answers(spark, sf)))


@catalog.add(J._FILES + " SELECT (SELECT count(*) FROM f) AS file_count, CAST(row_number() OVER (ORDER BY file_path) AS INT) AS place, file_path FROM f ORDER BY file_path LIMIT 100")
def java_first_files(spark, sf):
    """How many files there are, and the first hundred by path."""
    files = J.kept(spark, sf).select("file_path")
    first = files.orderBy("file_path").limit(100).withColumn("place", F.row_number().over(W.orderBy("file_path")))
    return first.crossJoin(files.agg(F.count("*").alias("file_count")))
