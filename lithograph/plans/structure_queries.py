"""Architecture reports over the generated Java files, each beside SQL that says the same from numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithograph.functions.order import numbered
from lithograph.operators import architecture as A
from lithograph.operators import structure as S
from lithograph.operators.render import LAYERS
from lithograph.plans import java_queries as J
from lithograph.plans.tables import Catalog
from lithograph.sources import java

catalog = Catalog()

BASE = "com.demo"


def roles(spark, sf):
    return S.detect(J.kept(spark, sf))


_KIND = {0: ("controller", "Presentation"), 1: ("service", "Business"), 2: ("repository", "Persistence"), 3: ("entity", "Data Model"), 4: ("configuration", "Configuration"), 5: ("utility", "Cross-cutting")}


def _by_kind(values) -> str:
    return "CASE t.k % 6 " + " ".join(f"WHEN {k} THEN {v}" for k, v in values.items()) + " END"


def _list(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


_MARKS = {0: "['RestController', 'RequestMapping', 'Autowired']", 1: "['Service', 'Autowired']", 2: "[]", 3: "['Entity', 'Table', 'Autowired']", 4: "['Configuration', 'Autowired']", 5: "['Deprecated', 'Autowired']"}
# A file's types share its annotations; helpers have none that tells, so their names or packages do.
_ROLES = J._GRAPH + f""", roles AS (SELECT t.id AS class_name, t.package, t.file_path, CASE WHEN t.kind = 'interface' AND t.place = 3 THEN 1 WHEN t.place = 3 THEN 1 ELSE 0 END AS place, {_by_kind({k: f"'{v[0]}'" for k, v in _KIND.items()})} AS role,
{_by_kind({k: f"'{v[1]}'" for k, v in _KIND.items()})} AS layer, CASE WHEN t.k % 6 = 2 THEN 'naming' WHEN t.k % 6 < 5 THEN 'annotation' WHEN t.place = 1 THEN 'naming' ELSE 'package' END AS detection_method,
CASE WHEN t.k % 6 = 2 THEN 'medium' WHEN t.k % 6 < 5 THEN 'high' WHEN t.place = 1 THEN 'medium' ELSE 'low' END AS confidence, {_by_kind(_MARKS)} AS annotations,
CASE WHEN t.k % 6 = 2 THEN 1 ELSE 3 + CAST(t.k % 9 = 0 AS INT) + CAST(t.k % 8 = 0 AS INT) END AS n_methods FROM t WHERE t.kind IN ('class', 'interface')),
places AS (SELECT x AS layer, CAST(i AS INT) AS place FROM (SELECT unnest({_list(LAYERS)}) AS x, unnest(range(1, {len(LAYERS)} + 1)) AS i)),
heads AS (SELECT layer, count(*) AS n, list(class_name ORDER BY file_path, place) AS names FROM roles WHERE layer NOT IN ('Unknown', 'Bootstrap') GROUP BY layer),
shown AS (SELECT h.*, p.place FROM heads h JOIN places p ON p.layer = h.layer)"""
_SAFE = "translate({}, '-. ', '___')"


def _label(column: str) -> str:
    return J._case(column, S.ROLE_LABELS, "")


@catalog.add(_ROLES + f" SELECT class_name, package, file_path, role, layer, detection_method, confidence, {_label('role')} AS label FROM roles")
def arch_roles(spark, sf):
    return roles(spark, sf).select("class_name", "package", "file_path", "role", "layer", "detection_method", "confidence", "label")


@catalog.add(_ROLES + " SELECT role, class_name, CAST(row_number() OVER (PARTITION BY role ORDER BY file_path, place) AS BIGINT) AS rank FROM roles")
def arch_role_members(spark, sf):
    """Classes of each role in their order, numbered."""
    return numbered(roles(spark, sf).select("role", "class_name", "file_path", "place"), [F.col("file_path"), F.col("place")], "rank", "role").select("role", "class_name", "rank")


@catalog.add(_ROLES + f""", own AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {_list(v)})" for k, v in S.LAYER_ROLES.items())}) v(layer, kinds)), m AS (SELECT DISTINCT layer, class_name FROM roles)
SELECT p.place, r.layer, count(*) AS class_count, count(DISTINCT package) AS packages,
(SELECT count(*) FROM edges e JOIN m ON m.class_name = e.dst LEFT JOIN nodes s ON s.id = e.src JOIN own o ON o.layer = m.layer WHERE m.layer = r.layer AND NOT list_contains(o.kinds, s.class_type)) AS inbound,
(SELECT count(*) FROM edges e JOIN m ON m.class_name = e.src WHERE m.layer = r.layer) AS outbound FROM roles r JOIN places p ON p.layer = r.layer GROUP BY p.place, r.layer""")
def arch_layers(spark, sf):
    files = J.kept(spark, sf)
    return S.layers(S.detect(files), *java.graph(files))


_MODULES = ", modules AS (SELECT string_split(package, '.')[3] AS module, count(*) AS members, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, bool_or(role = 'controller') AND bool_or(role = 'service') AND bool_or(role = 'repository') AS is_full_stack FROM roles GROUP BY 1)"


@catalog.add(_ROLES + _MODULES + " SELECT module, 'com.demo.' || module AS root_package, members, roles, is_full_stack FROM modules")
def arch_modules(spark, sf):
    return S.modules(roles(spark, sf), BASE)


_FACTS = """, facts AS (SELECT count(*) FILTER (WHERE role = 'controller' AND list_has_any(annotations, ['RestController', 'RequestMapping'])) AS rest_controllers, count(*) FILTER (WHERE role = 'entity') AS entities,
count(*) FILTER (WHERE role = 'repository' AND list_contains(annotations, 'Repository')) AS spring_data, count(*) FILTER (WHERE role = 'dto') AS dtos FROM roles)"""


@catalog.add(_ROLES + _FACTS + " SELECT CAST(NULL AS VARCHAR) AS entry_point, CAST(NULL AS VARCHAR) AS main_package, rest_controllers, entities, spring_data, false AS has_security, false AS has_scheduling, false AS has_async, dtos FROM facts")
def arch_patterns(spark, sf):
    return S.patterns(roles(spark, sf))


_SAID = """SELECT 1 AS k, 'REST API: ' || rest_controllers || ' REST controller(s)' AS line FROM facts WHERE rest_controllers > 0 UNION ALL SELECT 2, 'JPA/ORM: ' || entities || ' entity class(es)' FROM facts WHERE entities > 0"""


@catalog.add(_ROLES + _FACTS + " " + _SAID)
def arch_pattern_lines(spark, sf):
    return S.pattern_lines(S.patterns(roles(spark, sf)))


_STATS = "SELECT 'com.demo' AS base_package, count(*) AS total_classes, count(*) AS detected_classes, CAST(0 AS BIGINT) AS unknown_classes, 1.0::DOUBLE AS detection_rate, count(DISTINCT layer) AS layer_count, count(DISTINCT role) AS role_count, count(DISTINCT string_split(package, '.')[3]) AS module_count FROM roles"


@catalog.add(_ROLES + " " + _STATS)
def arch_stats(spark, sf):
    files = J.kept(spark, sf)
    base = A.base_package(files.select("package")).first().base
    return S.stats(S.detect(files), base)


@catalog.add(_ROLES + " SELECT 'Spring Boot' AS framework, 2 AS features, count(DISTINCT a) AS marks, false AS imported FROM (SELECT unnest(annotations) AS a FROM roles) WHERE a <> 'Deprecated'")
def arch_framework(spark, sf):
    files = J.kept(spark, sf)
    return S.framework(files, S.detect(files))


_STYLE = J._case("layer", S.LAYER_STYLE, "")
_BOX, _NODE = _SAFE.format("layer"), _SAFE.format("name")


def _fixed(part: int, lines) -> str:
    return " UNION ALL ".join(f"SELECT {part}, {k}, {_quote(t)}" for k, t in enumerate(lines))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _arrows(part: int, pairs, text) -> str:
    return " UNION ALL ".join(f"SELECT {part}, {k}, {_quote(text(*p))} WHERE EXISTS (SELECT 1 FROM shown WHERE layer = '{p[0]}') AND EXISTS (SELECT 1 FROM shown WHERE layer = '{p[1]}')" for k, p in enumerate(pairs))


def _ident(name: str) -> str:
    return name.replace("-", "_").replace(" ", "_")


@catalog.add(_ROLES + f""", each AS (SELECT layer, place, unnest(names[1:12]) AS name, unnest(range(0, least(n, 12))) AS k FROM shown), text_(part, k, line) AS (
{_fixed(0, S.LAYER_HEAD)} UNION ALL SELECT place * 10, 0, '    subgraph ' || {_BOX} || '["' || layer || ' Layer (' || n || ' classes)"]' FROM shown
UNION ALL SELECT place * 10 + 1, k, '        ' || {_NODE} || '[' || name || ']' FROM each UNION ALL SELECT place * 10 + 2, 0, '        more' || {_BOX} || '[...' || (n - 12) || ' more]' FROM shown WHERE n > 12
UNION ALL SELECT place * 10 + 3, 0, '    end' FROM shown UNION ALL {_arrows(200, S.LAYER_ARROWS, lambda a, b: f"    {a} --> {b}")} UNION ALL SELECT place + 300, k, '    style ' || {_NODE} || ' ' || {_STYLE} FROM each)
SELECT CAST(part AS INT) AS part, CAST(k AS BIGINT) AS k, line FROM text_""")
def arch_layer_diagram(spark, sf):
    return S.layer_diagram(roles(spark, sf))


@catalog.add(_ROLES + f""", c AS (SELECT package, role, count(*) AS n FROM roles GROUP BY ALL), p AS (SELECT package, CAST(sum(n) AS BIGINT) AS n, arg_min(role, lpad(CAST(1000000000 - n AS VARCHAR), 12, '0') || role) AS role FROM c GROUP BY package)
SELECT 0 AS part, '0' AS key, 'graph LR' AS line UNION ALL SELECT 0, '1', '    %% Package Structure Diagram' UNION ALL SELECT 0, '2', '    com_demo["com.demo"]'
UNION ALL SELECT 1, package, '    ' || {_SAFE.format('package')} || '["' || string_split(package, '.')[-1] || ' (' || {_label('role')} || ', ' || n || ')"]' FROM p
UNION ALL SELECT 2, package, '    ' || {_SAFE.format("regexp_replace(package, '[.][^.]*$', '')")} || ' --> ' || {_SAFE.format('package')} FROM p""")
def arch_package_diagram(spark, sf):
    return S.package_diagram(roles(spark, sf), BASE)


@catalog.add(_ROLES + f""" SELECT 0 AS part, 0 AS k, '' AS key, 'pie title Architecture Component Distribution' AS line UNION ALL SELECT 1, -count(*), role, '    "' || {_label('role')} || '" : ' || count(*) FROM roles GROUP BY role""")
def arch_component_pie(spark, sf):
    return S.component_pie(roles(spark, sf))


_FIRST = "coalesce((SELECT class_name FROM roles WHERE role = '{}' ORDER BY file_path, place LIMIT 1), '{}')"


@catalog.add(_ROLES + f""", one AS (SELECT {_FIRST.format('controller', 'Controller')} AS c, {_FIRST.format('service', 'Service')} AS s, {_FIRST.format('repository', 'Repository')} AS r), text_(part, k, t) AS ({_fixed(0, S.FLOW_LINES)})
SELECT CAST(part AS INT) AS part, CAST(k AS BIGINT) AS k, replace(replace(replace(t, '{{c}}', c), '{{s}}', s), '{{r}}', r) AS line FROM text_, one""")
def arch_request_flow(spark, sf):
    return S.request_flow(roles(spark, sf))


@catalog.add(_ROLES + f""", text_(part, k, line) AS ({_fixed(0, S.FLOW_HEAD)}
UNION ALL SELECT 1, place, '    ' || {_BOX} || '["' || layer || '\\n' || array_to_string(names[1:4], ', ') || CASE WHEN n > 4 THEN ' +' || (n - 4) || ' more' ELSE '' END || '"]' FROM shown UNION ALL SELECT 2, 0, ''
UNION ALL SELECT 3, 0, '    Client -->|HTTP| Presentation' FROM shown WHERE layer = 'Presentation' UNION ALL {_arrows(4, S.FLOW_ARROWS, lambda a, b, t: f'    {_ident(a)} -->|"{t}"| {_ident(b)}')}
UNION ALL SELECT 5, place, '    style ' || {_BOX} || ' ' || {_STYLE} FROM shown) SELECT CAST(part AS INT) AS part, CAST(k AS BIGINT) AS k, line FROM text_""")
def arch_dependency_flow(spark, sf):
    return S.dependency_flow(roles(spark, sf))


@catalog.add(_ROLES + """, one AS (SELECT count(*) FILTER (WHERE role = 'controller') AS c, count(*) FILTER (WHERE role = 'service') AS s, count(*) FILTER (WHERE role = 'repository') AS r, count(*) FILTER (WHERE role = 'entity') AS e FROM roles), text_(part, k, line) AS (
SELECT 0, unnest(range(13)), unnest([repeat('=', 60), '  C4 Model -- Level 2: Container', repeat('=', 60), '', 'Containers:', '', '  [Container: Spring Boot Application]  Demo-service', '    Technology : Java {}, Spring Boot', '    Description: Main application container. Hosts',
  '                 ' || c || ' controller(s),', '                 ' || s || ' service(s),', '                 ' || r || ' repository/repositories.', '']) FROM one
UNION ALL SELECT 1, unnest(range(5)), unnest(['  [Container: Database]  relational-db', '    Technology : PostgreSQL / MySQL / H2 (via JPA/Hibernate)', '    Description: Persistent storage for', '                 ' || e || ' entity type(s).', '']) FROM one WHERE e > 0
UNION ALL SELECT 3, unnest(range(3)), unnest(['Container Relationships:', '  Client        --[HTTPS/REST/JSON]-->  Demo-service', '  Demo-service  --[JDBC/JPA]-->   relational-db'])) SELECT CAST(part AS INT) AS part, CAST(k AS BIGINT) AS k, line FROM text_""")
def arch_c4_container(spark, sf):
    return S.container_text(roles(spark, sf), "Demo")


@catalog.add(_ROLES + """, own AS (SELECT *, CASE WHEN len(annotations) > 0 THEN ' [@' || array_to_string(annotations[1:3], ', @') || ']' ELSE '' END AS marks FROM roles WHERE layer = 'Business')
SELECT 0 AS part, '' AS key, CAST(unnest(range(9)) AS INT) AS k, unnest([repeat('=', 60), '  C4 Model -- Level 3: Component (Business Layer)', repeat('=', 60), '', 'Layer: Business', 'Classes: ' || (SELECT count(*) FROM own),
  'Packages: ' || array_to_string(list_sort((SELECT list(DISTINCT package) FROM own))[1:5], ', '), '', 'Components:']) AS line
UNION ALL SELECT 1, class_name || ' ' || package, CAST(unnest(range(4)) AS INT), unnest(['  [Component]  ' || class_name || marks, '               Package: ' || package, '               Methods: ' || n_methods || '  Detection: ' || detection_method || ' (' || confidence || ')', '']) FROM own""")
def arch_c4_component(spark, sf):
    return S.component_text(roles(spark, sf), "Business")


@catalog.add(_ROLES + _MODULES + _FACTS + f""", one AS (SELECT count(*) FILTER (WHERE role = 'controller') AS c, count(*) FILTER (WHERE role = 'service') AS s, count(*) FILTER (WHERE role = 'repository') AS r, count(*) AS n,
{_FIRST.format('controller', '')} AS fc, {_FIRST.format('service', '')} AS fs, (SELECT list(layer ORDER BY place) FROM (SELECT DISTINCT p.layer, p.place FROM roles r JOIN places p ON p.layer = r.layer)) AS l,
(SELECT string_agg(module, ', ' ORDER BY module) FROM (SELECT module FROM modules ORDER BY module LIMIT 8)) AS ms, (SELECT count(*) FROM modules) AS m, (SELECT count(*) FROM modules WHERE is_full_stack) AS full_, (SELECT string_agg(line, '; ' ORDER BY k) FROM ({_SAID})) AS said FROM roles)
SELECT 'layer_summary' AS name, 'The application uses a ' || len(l) || '-layer architecture: ' || array_to_string(l, ', ') || '. The presentation layer contains ' || c || ' controller(s), the business layer has ' || s || ' service(s), and the persistence layer exposes ' || r || ' repository/repositories.' AS text FROM one
UNION ALL SELECT 'module_summary', m || ' module(s) detected. ' || CASE WHEN full_ > 0 THEN full_ || ' are full-stack (controller + service + repository). ' ELSE '' END || 'Modules: ' || ms || '.' FROM one
UNION ALL SELECT 'spring_patterns', 'Spring Boot patterns detected: ' || said || '.' FROM one
UNION ALL SELECT 'onboarding_intro', 'This is a Spring Boot application (entry point: the main Application class) with ' || n || ' Java classes. Start by reading ' || fc || ' to understand the API surface, then trace through ' || fs || ' for business logic. The codebase follows a standard layered architecture with ' || array_to_string(l[1:3], ', ') || ' layers.' FROM one
UNION ALL SELECT 'quick_start', 'Key entry points: controller: ' || fc || '; service: ' || fs || '. Trace a request from Controller -> Service -> Repository to understand the data flow.' FROM one
UNION ALL SELECT 'critique', 'No major architectural issues detected from static analysis.'""")
def arch_summaries(spark, sf):
    return S.summaries(roles(spark, sf), BASE)


def _answers(spark, sf):
    files = J.kept(spark, sf)
    return S.aspects(S.detect(files), *java.graph(files), BASE)


_AVAILABLE = _ROLES + " SELECT DISTINCT 0 AS part, layer AS key, 'Available: ' || layer AS line FROM roles"


@catalog.add(_AVAILABLE)
def arch_layer_detail_missing(spark, sf):
    """A layer that is not there: the layers that are."""
    return _answers(spark, sf)["layer_detail"](layer="Integration")


@catalog.add(_ROLES + """ SELECT 0 AS part, '' AS key, 'Layer: Business (' || count(*) || ' classes)' AS line FROM roles WHERE layer = 'Business'
UNION ALL SELECT 1, class_name || ' ' || package, '  ' || class_name || ' [@' || array_to_string(annotations[1:3], ',') || '] in ' || package FROM roles WHERE layer = 'Business'""")
def arch_layer_detail(spark, sf):
    return _answers(spark, sf)["layer_detail"](layer="Business")


@catalog.add(_ROLES + _MODULES + """ SELECT 0 AS part, CAST(unnest(range(4)) AS VARCHAR) AS key, unnest(['Module: m3', 'Root Package: com.demo.m3', 'Full Stack: ' || CASE WHEN is_full_stack THEN 'yes' ELSE 'no' END, 'Roles: ' || roles]) AS line FROM modules WHERE module = 'm3'
UNION ALL SELECT 1, class_name || ' ' || package, '  ' || class_name || ' (' || role || ')' FROM roles WHERE package LIKE 'com.demo.m3.%'""")
def arch_module_detail(spark, sf):
    return _answers(spark, sf)["module_detail"](module="m3")


_SHORT = ("summary", "layers", "modules", "spring_patterns", "roles", "health")


@catalog.add(_ROLES + _MODULES + _FACTS + f""", st AS ({_STATS}), counts AS (SELECT role, count(*) AS n, list(class_name ORDER BY class_name, package)[1:5] AS names FROM roles GROUP BY role)
SELECT 'summary' AS aspect, unnest(['base_package', 'total_classes', 'detected_classes', 'unknown_classes', 'module_count']) AS key, unnest(['  base_package: ' || base_package, '  total_classes: ' || total_classes, '  detected_classes: ' || detected_classes, '  unknown_classes: ' || unknown_classes, '  module_count: ' || module_count]) AS line FROM st
UNION ALL SELECT 'layers', lpad(CAST(p.place AS VARCHAR), 3, '0'), '  ' || rpad(r.layer, 20, ' ') || ' ' || CASE WHEN count(*) < 1000 THEN lpad(CAST(count(*) AS VARCHAR), 3, ' ') ELSE CAST(count(*) AS VARCHAR) END || ' class(es)' FROM roles r JOIN places p ON p.layer = r.layer GROUP BY p.place, r.layer
UNION ALL SELECT 'modules', module, '  ' || rpad(module, 20, ' ') || ' ' || CASE WHEN members < 1000 THEN lpad(CAST(members AS VARCHAR), 3, ' ') ELSE CAST(members AS VARCHAR) END || ' classes  roles: ' || replace(roles, ',', ', ') || CASE WHEN is_full_stack THEN ' [full-stack]' ELSE '' END FROM modules
UNION ALL SELECT 'spring_patterns', CAST(k AS VARCHAR), '  + ' || line FROM ({_SAID})
UNION ALL SELECT 'roles', lpad(CAST(1073741824 - n AS VARCHAR), 12, '0') || ' ' || role, '  ' || rpad({_label('role')}, 25, ' ') || ' (' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, ' ') ELSE CAST(n AS VARCHAR) END || '): ' || array_to_string(list_sort(names), ', ') || CASE WHEN n > 5 THEN ' +' || (n - 5) || ' more' ELSE '' END FROM counts
UNION ALL SELECT 'health', unnest(['total_classes', 'detected_classes', 'unknown_classes', 'detection_rate']), unnest(['  total_classes: ' || total_classes, '  detected_classes: ' || detected_classes, '  unknown_classes: ' || unknown_classes, '  detection_rate: 1.0']) FROM st""")
def arch_aspects(spark, sf):
    """The short answers, by name."""
    answers = _answers(spark, sf)
    return S.union(*(answers[name]().select(F.lit(name).alias("aspect"), "key", "line") for name in _SHORT))


@catalog.add(_ROLES + """, ly AS (SELECT layer, count(*) AS n FROM roles GROUP BY layer), coupled AS (SELECT count(*) AS n FROM (SELECT id FROM nodes WHERE id IN (SELECT src FROM edges) OR id IN (SELECT dst FROM edges) LIMIT 15))
SELECT unnest(range(1, 9)) AS section, unnest(['## 1. Project Overview', '## 2. Architecture', '## 3. Detected Patterns', '## 4. Key Components', '## 5. Modules', '## 6. Dependencies', '## 7. Request Flow', '## 8. Technical Debt']) AS heading,
unnest([3, 1 + (SELECT count(*) FROM ly), 3, 1 + (SELECT count(DISTINCT role) FROM roles), 1 + (SELECT count(DISTINCT string_split(package, '.')[3]) FROM roles), 1 + (SELECT n FROM coupled), 19, 2]) AS lines""")
def document_advanced(spark, sf):
    """The sections of the document for an advanced reader: heading and number of lines."""
    from lithograph.operators import document

    files = J.kept(spark, sf)
    rows = document.sections(S.detect(files), *java.graph(files), BASE, "advanced")
    return rows.groupBy(F.col("section").cast("long").alias("section")).agg(F.max(F.when(F.col("part") == 0, F.col("line"))).alias("heading"), F.count("*").alias("lines"))


def _titled(part: int, title: str) -> str:
    return f"SELECT {part} AS part, unnest(['000', '001']) AS key, unnest(['', '{title}']) AS line"


_NAMED = "array_to_string(names[1:{0}], ', ') || CASE WHEN n > {0} THEN ' (+' || (n - {0}) || ' more)' ELSE '' END"


@catalog.add(_ROLES + _MODULES + _FACTS + f""", by_layer AS (SELECT r.layer, p.place AS spot, count(*) AS n, list(class_name ORDER BY file_path, r.place) AS names FROM roles r JOIN places p ON p.layer = r.layer GROUP BY r.layer, p.place),
by_role AS (SELECT role, count(*) AS n, list(class_name ORDER BY file_path, place) AS names FROM roles WHERE role <> 'unknown' GROUP BY role)
SELECT 0 AS part, unnest(['0', '1']) AS key, unnest(['Base Package: com.demo', 'Total Classes: ' || (SELECT count(*) FROM roles)]) AS line
UNION ALL {_titled(1, "Layers:")} UNION ALL SELECT 2, lpad(CAST(spot AS VARCHAR), 3, '0'), '  ' || layer || ' (' || n || '): ' || {_NAMED.format(8)} FROM by_layer
UNION ALL {_titled(3, "Modules:")} UNION ALL SELECT 4, module, '  ' || module || ': ' || members || ' classes [' || replace(roles, ',', ', ') || '] ' || CASE WHEN is_full_stack THEN '(full-stack)' ELSE '' END FROM modules
UNION ALL {_titled(5, "Spring Boot Patterns:")} UNION ALL SELECT 6, CAST(k AS VARCHAR), '  - ' || line FROM ({_SAID})
UNION ALL {_titled(7, "Role Breakdown:")} UNION ALL SELECT 8, lpad(CAST(1073741824 - n AS VARCHAR), 12, '0') || ' ' || role, '  ' || {_label('role')} || ': ' || {_NAMED.format(5)} FROM by_role""")
def arch_report_text(spark, sf):
    """The whole report on an architecture, as ordered lines."""
    return S.report_lines(roles(spark, sf), BASE)


def _document_sql() -> str:
    """Each section from the SQL of the query that tells its contents."""
    from lithograph.operators import document as D

    of = lambda name: f"({catalog.sql.get(name) or J.catalog.sql[name]})"
    said = lambda *names: f"SELECT 2 AS part, name AS key, text AS line FROM {of('arch_summaries')} WHERE name IN ({', '.join(map(_quote, names))})"
    coupled = f"(SELECT *, lpad(CAST(1000000000 - ca - ce AS VARCHAR), 10, '0') || '-' || id AS key FROM {of('java_coupling')} WHERE ca + ce > 0 ORDER BY ca + ce DESC, id LIMIT {D.NAMED})"
    made = {
        "overview": said("onboarding_intro", "layer_summary"), "getting_started": said("quick_start"), "recommendations": said("critique"),
        "architecture": f"SELECT 2, lpad(CAST(place AS VARCHAR), 3, '0'), '| ' || layer || ' | ' || class_count || ' | ' || inbound || ' | ' || outbound || ' |' FROM {of('arch_layers')}",
        "patterns": f"SELECT 2, CAST(k AS VARCHAR), '* ' || line FROM {of('arch_pattern_lines')}", "components": f"SELECT 2, key, line FROM {of('arch_aspects')} WHERE aspect = 'roles'",
        "modules": f"SELECT 2, module, '| ' || module || ' | ' || members || ' | ' || roles || ' |' FROM {of('arch_modules')}",
        "dependencies": f"SELECT 2, key, '* ' || id || ': ' || (ca + ce) FROM {coupled}", "coupling_metrics": f"SELECT 2, key, '| ' || id || ' | ' || ca || ' | ' || ce || ' | ' || printf('%.2f', instability) || ' |' FROM {coupled}",
        "request_flow": f"SELECT part + 1, lpad(CAST(k AS VARCHAR), 10, '0'), line FROM {of('arch_request_flow')}", "c4": f"SELECT part + 1, lpad(CAST(k AS VARCHAR), 10, '0'), line FROM {of('arch_c4_container')}",
        "debt": f"SELECT 2, '0', count(*) || ' highly coupled class(es)' FROM {of('java_coupling')} WHERE highly_coupled",
        "glossary": " UNION ALL ".join(f"SELECT 2, '{k:02d}', {_quote(f'* {a}: {b}')}" for k, (a, b) in enumerate(D.GLOSSARY)),
    }
    tables = ", ".join(f"{name}(part, key, line) AS MATERIALIZED ({sql})" for name, sql in made.items())
    rows = []
    for level, names in D.SECTIONS.items():
        for n, name in enumerate(names, 1):
            rows.append(f"SELECT '{level}' AS level, {n} AS section, 0 AS part, '' AS key, {_quote(f'## {n}. {D.TITLES[name]}')} AS line UNION ALL SELECT '{level}', {n}, CAST(part AS INT), key, line FROM {name}")
    return f"WITH {tables} " + " UNION ALL ".join(rows)


@catalog.add(_document_sql())
def document_lines(spark, sf):
    """Every line of the documents for all levels of reader."""
    from lithograph.operators import document

    files = J.kept(spark, sf)
    return document.documents(S.detect(files), *java.graph(files), BASE)
