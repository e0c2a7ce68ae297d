"""Reports on an architecture as ordered lines: layers, diagrams, C4 texts, summaries, answers to named questions.

Roles are rows (class_name, package, file_path, place, role, layer, detection_method,
confidence, annotations, n_methods); their order is that of files, then of places.  A text is
a table (part, k, line): written in the order of part and k it is the text, and nothing is
gathered but the first few names of a group and totals of roles, layers and modules.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.operators import architecture as A
from lithograph.operators.relational import top_per_group
from lithograph.operators.render import LAYERS

# Labels of roles, roles of layers, styles of layers, arrows between layers, and framework marks.
ROLE_LABELS = {
    "controller": "Controllers", "service": "Services", "repository": "Repositories", "entity": "Entities", "dto": "DTOs", "configuration": "Configuration",
    "component": "Components", "exception": "Exceptions", "utility": "Utilities", "security": "Security", "main": "Application Entry Points", "unknown": "Unclassified",
}
LAYER_ROLES = {
    "Presentation": ("controller",), "Business": ("service", "component"), "Persistence": ("repository",), "Data Model": ("entity",), "Data Transfer": ("dto",),
    "Configuration": ("configuration",), "Security": ("security",), "Cross-cutting": ("exception", "utility"), "Bootstrap": ("main",), "Unknown": ("unknown",),
}
LAYER_STYLE = {
    "Presentation": "fill:#FF6B6B,stroke:#cc0000,color:#fff", "Business": "fill:#4ECDC4,stroke:#009688,color:#fff", "Persistence": "fill:#45B7D1,stroke:#0288d1,color:#fff",
    "Data Model": "fill:#96CEB4,stroke:#388e3c,color:#000", "Data Transfer": "fill:#FFEAA7,stroke:#f9a825,color:#000", "Configuration": "fill:#DDA0DD,stroke:#7b1fa2,color:#000",
    "Security": "fill:#F4A460,stroke:#e65100,color:#000", "Cross-cutting": "fill:#D3D3D3,stroke:#616161,color:#000", "Bootstrap": "fill:#98FB98,stroke:#2e7d32,color:#000",
}
HIDDEN_LAYERS = ("Unknown", "Bootstrap")
LAYER_ARROWS = (("Presentation", "Business"), ("Business", "Persistence"))
FLOW_ARROWS = (("Presentation", "Business", "delegates to"), ("Business", "Persistence", "queries"), ("Persistence", "Data Model", "maps to"), ("Business", "Data Transfer", "returns"))
FRAMEWORK_ANNOTATIONS = (
    "SpringBootApplication", "EnableAutoConfiguration", "RestController", "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "Service", "Repository", "Component",
    "Configuration", "Autowired", "Inject", "Bean", "Transactional", "Entity", "Table", "MappedSuperclass", "EnableJpaRepositories", "EnableWebSecurity", "Scheduled", "Async", "EventListener",
)
FRAMEWORK_IMPORTS = ("org.springframework.", "javax.persistence.", "jakarta.persistence.")
CORE_BOOT = ("RestController", "SpringBootApplication", "EnableAutoConfiguration")

# The lines of diagrams and texts, and the wording of summaries.
LAYER_HEAD = ("graph TB", "    %% Architectural Layer Diagram")
PACKAGE_HEAD = ("graph LR", "    %% Package Structure Diagram")
PIE_HEAD = "pie title Architecture Component Distribution"
FLOW_HEAD = ("flowchart TD", "    %% Dependency Flow Diagram", "", "    Client([HTTP Client])", "")
FLOW_LINES = (
    "sequenceDiagram", "    autonumber", "    participant Client", "    participant {c}", "    participant {s}", "    participant {r}", "    participant Database", "", "    Client->>{c}: HTTP Request", "    {c}->>{c}: Validate input / map DTO",
    "    {c}->>{s}: Call business method", "    {s}->>{s}: Apply business rules", "    {s}->>{r}: Query data", "    {r}->>Database: SQL / NoSQL query", "    Database-->>{r}: Result set", "    {r}-->>{s}: Entity / domain object",
    "    {s}-->>{c}: DTO / response object", "    {c}->>Client: HTTP Response (JSON)",
)
BAR = "=" * 60
CONTAINER_MAIN = (
    BAR, "  C4 Model -- Level 2: Container", BAR, "", "Containers:", "", "  [Container: Spring Boot Application]  {app}-service", "    Technology : Java {}, Spring Boot", "    Description: Main application container. Hosts",
    "                 %d controller(s),", "                 %d service(s),", "                 %d repository/repositories.", "",
)
CONTAINER_STORE = ("  [Container: Database]  relational-db", "    Technology : PostgreSQL / MySQL / H2 (via JPA/Hibernate)", "    Description: Persistent storage for", "                 %d entity type(s).", "")
CONTAINER_CACHE = ("  [Container: Cache]  redis-cache", "    Technology : Redis", "    Description: Distributed cache layer.", "")
CONTAINER_TAIL = ("Container Relationships:", "  Client        --[HTTPS/REST/JSON]-->  {app}-service", "  {app}-service  --[JDBC/JPA]-->   relational-db")
PATTERN_TEXTS = (
    "Spring Boot application: %s", "REST API: %d REST controller(s)", "JPA/ORM: %d entity class(es)", "Spring Data: %d repository/repositories", "Spring Security configured", "Scheduled tasks (@Scheduled)",
    "Async processing (@Async)", "DTO pattern: %d transfer object(s)",
)
SUMMARY_TEXTS = {
    "layer_summary": "The application uses a %d-layer architecture: %s. The presentation layer contains %d controller(s), the business layer has %d service(s), and the persistence layer exposes %d repository/repositories.",
    "modules": "%d module(s) detected. ",
    "full_stack": "%d are full-stack (controller + service + repository). ",
    "module_names": "Modules: %s.",
    "no_modules": "No distinct feature modules detected. The codebase appears to use a flat, role-based package structure (all controllers in one package, all services in another).",
    "patterns": "Spring Boot patterns detected: %s.",
    "no_patterns": "No specific Spring Boot patterns detected.",
    "onboarding_intro": "This is a Spring Boot application (entry point: %s) with %d Java classes. Start by reading %s to understand the API surface, then trace through %s for business logic. The codebase follows a standard layered architecture with %s layers.",
    "quick_start": "Key entry points: %s. Trace a request from Controller -> Service -> Repository to understand the data flow.",
    "unclassified": "%d unclassified class(es) -- consider adding Spring stereotypes or renaming: %s",
    "flat": "No feature modules detected -- consider organising by feature (order/, customer/, etc.) rather than by role.",
    "issues": "Architecture issues found: %s",
    "no_issues": "No major architectural issues detected from static analysis.",
}

ORDER = ("file_path", "place")


def detect(parsed: DataFrame) -> DataFrame:
    """Roles of all classes and interfaces of parsed files; of equal (package, name) the first stays."""
    rows = parsed.select("file_path", F.coalesce("package", F.lit("")).alias("package"), "annotations", "interfaces", F.size("methods").alias("n_methods"), F.posexplode(F.concat("classes", "interfaces")).alias("place", "class_name"))
    rest = ("file_path", "place", "annotations", "interfaces", "n_methods")
    first = rows.groupBy("package", "class_name").agg(F.min_by(F.struct(*rest), F.struct(*ORDER)).alias("r")).select("package", "class_name", "r.*")
    return A.classify(first).withColumn("label", lookup(ROLE_LABELS, "role"))


def lookup(table: dict, key: str, default: str | None = None) -> Column:
    found = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(key)]
    return found if default is None else F.coalesce(found, F.lit(default))


def safe(name) -> Column:
    """A name that a diagram takes for an identifier."""
    return F.translate(name, "-. ", "___")


def heads(roles: DataFrame, by: str, most: int) -> DataFrame:
    """(by, n, names): how many classes a group has, and its first ones in order."""
    first = top_per_group(roles.select(by, *ORDER, "class_name"), [by], [F.col(c) for c in ORDER], most)
    names = F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "class_name"))), lambda s: s["class_name"])
    return roles.groupBy(by).agg(F.count("*").alias("n")).join(first.groupBy(by).agg(names.alias("names")), by)


def layer_heads(roles: DataFrame, most: int, hidden: tuple = HIDDEN_LAYERS) -> DataFrame:
    place = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")).cast("int")
    return heads(roles.where(~F.col("layer").isin(*hidden)), "layer", most).withColumn("place", place)


def more(n, most: int, text: str) -> Column:
    return F.when(n > most, F.format_string(text, n - most)).otherwise("")


def lines(spark, part: int, texts) -> DataFrame:
    return spark.createDataFrame([(part, k, t) for k, t in enumerate(texts)], "part int, k long, line string")


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row(part: int, k, line: Column) -> list[Column]:
    return [F.lit(part).alias("part"), F.lit(k).cast("long").alias("k") if isinstance(k, int) else k.cast("long").alias("k"), line.alias("line")]


def arrows(present: DataFrame, part: int, pairs: tuple, text) -> DataFrame:
    """A line for each pair of layers that are both there."""
    spark = present.sparkSession
    table = spark.createDataFrame([(k, p[0], p[1], text(*p)) for k, p in enumerate(pairs)], "k long, a string, b string, line string")
    layers = present.select("layer")
    both = table.join(layers.withColumnRenamed("layer", "a"), "a", "left_semi").join(layers.withColumnRenamed("layer", "b"), "b", "left_semi")
    return both.select(F.lit(part).alias("part"), "k", "line")


def layer_diagram(roles: DataFrame, most: int = 12) -> DataFrame:
    """Classes in boxes by layer, the first of each; arrows; styles."""
    spark, shown = roles.sparkSession, layer_heads(roles, most)
    box, node = safe("layer"), safe(F.col("name"))
    each = shown.select("layer", "place", F.posexplode("names").alias("k", "name"))
    return union(
        lines(spark, 0, LAYER_HEAD),
        shown.select((F.col("place") * 10).alias("part"), F.lit(0).cast("long").alias("k"), F.format_string('    subgraph %s["%s Layer (%d classes)"]', box, "layer", "n").alias("line")),
        each.select((F.col("place") * 10 + 1).alias("part"), F.col("k").cast("long").alias("k"), F.concat(F.lit("        "), node, F.lit("["), "name", F.lit("]")).alias("line")),
        shown.where(F.col("n") > most).select((F.col("place") * 10 + 2).alias("part"), F.lit(0).cast("long").alias("k"), F.format_string("        more%s[...%d more]", box, F.col("n") - most).alias("line")),
        shown.select((F.col("place") * 10 + 3).alias("part"), F.lit(0).cast("long").alias("k"), F.lit("    end").alias("line")),
        arrows(shown, 200, LAYER_ARROWS, lambda a, b: f"    {a} --> {b}"),
        each.select((F.col("place") + 300).alias("part"), F.col("k").cast("long").alias("k"), F.concat(F.lit("    style "), node, F.lit(" "), lookup(LAYER_STYLE, "layer")).alias("line")),
    )


def package_diagram(roles: DataFrame, base: str) -> DataFrame:
    """A node for each package with its commonest role; edges to the package above; k orders by hash-free text: (part, key, line)."""
    spark = roles.sparkSession
    counts = roles.withColumn("package", F.when(F.col("package") == "", "(default)").otherwise(F.col("package"))).groupBy("package").agg(F.count("*").alias("n"))
    main = A.dominant(roles.withColumn("package", F.when(F.col("package") == "", "(default)").otherwise(F.col("package"))), "package", "role").withColumnRenamed("dominant", "role").drop("n")
    simple = F.element_at(F.split("package", r"\."), -1)
    node = F.format_string('    %s["%s (%s, %d)"]', safe("package"), simple, lookup(ROLE_LABELS, "role"), "n")
    above = F.regexp_replace("package", r"\.[^.]*$", "")
    inside = F.col("package").startswith(base) & (F.col("package") != base)
    head = spark.createDataFrame([*((0, str(k), t) for k, t in enumerate(PACKAGE_HEAD)), *([(0, "2", f'    {base.replace(".", "_")}["{base}"]')] if base else [])], "part int, key string, line string")
    nodes = counts.join(main, "package").select(F.lit(1).alias("part"), F.col("package").alias("key"), node.alias("line"))
    edges = counts.where(inside).select(F.lit(2).alias("part"), F.col("package").alias("key"), F.concat(F.lit("    "), safe(above), F.lit(" --> "), safe("package")).alias("line"))
    return union(head, nodes, edges)


def component_pie(roles: DataFrame) -> DataFrame:
    """Classes by role, most first; ties by role."""
    counts = roles.where("role <> 'unknown'").groupBy("role").agg(F.count("*").alias("n"))
    line = F.format_string('    "%s" : %d', lookup(ROLE_LABELS, "role"), "n")
    head = roles.sparkSession.createDataFrame([(0, 0, "", PIE_HEAD)], "part int, k long, key string, line string")
    return head.unionByName(counts.select(F.lit(1).alias("part"), (-F.col("n")).alias("k"), F.col("role").alias("key"), line.alias("line")))


def first_of(roles: DataFrame, role: str, otherwise: str) -> Column:
    return F.coalesce(F.min_by("class_name", F.when(F.col("role") == role, F.struct(*ORDER))), F.lit(otherwise))


def request_flow(roles: DataFrame) -> DataFrame:
    """A request through the first controller, service and repository."""
    # min_by skips rows whose order is null; a group without any gives null.
    facts = roles.agg(*(first_of(roles, role, name).alias(key) for key, role, name in (("c", "controller", "Controller"), ("s", "service", "Service"), ("r", "repository", "Repository"))))
    text = roles.sparkSession.createDataFrame([(0, k, t) for k, t in enumerate(FLOW_LINES)], "part int, k long, t string")
    line = F.col("t")
    for key in ("c", "s", "r"):
        line = F.replace(line, F.lit("{" + key + "}"), F.col(key))
    return text.crossJoin(F.broadcast(facts)).select("part", "k", line.alias("line"))


def dependency_flow(roles: DataFrame, most: int = 4) -> DataFrame:
    """Layers with their first classes, the usual arrows between them, styles."""
    spark, shown = roles.sparkSession, layer_heads(roles, most)
    node = F.concat(F.lit("    "), safe("layer"), F.lit('["'), "layer", F.lit("\\n"), F.array_join("names", ", "), more(F.col("n"), most, " +%d more"), F.lit('"]'))
    ident = lambda name: name.replace("-", "_").replace(" ", "_")
    at = F.col("place").cast("long").alias("k")
    return union(
        lines(spark, 0, FLOW_HEAD),
        shown.select(F.lit(1).alias("part"), at, node.alias("line")),
        lines(spark, 2, ("",)),
        shown.where("layer = 'Presentation'").select(*row(3, 0, F.lit("    Client -->|HTTP| Presentation"))),
        arrows(shown, 4, FLOW_ARROWS, lambda a, b, t: f'    {ident(a)} -->|"{t}"| {ident(b)}'),
        shown.select(F.lit(5).alias("part"), at, F.concat(F.lit("    style "), safe("layer"), F.lit(" "), lookup(LAYER_STYLE, "layer")).alias("line")),
    )


def layers(roles: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per layer, outside in: classes, packages, edges that enter it from a class of another kind, all edges that leave its classes."""
    place = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")).cast("int").alias("place")
    members = roles.select("layer", "class_name").distinct()
    own = F.create_map(*(x for k, v in LAYER_ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    kinds = nodes.select(F.col("id").alias("src"), "class_type")
    enter = edges.join(members.withColumnRenamed("class_name", "dst"), "dst").join(kinds, "src", "left").where(~F.coalesce(F.array_contains(own[F.col("layer")], F.col("class_type")), F.lit(False)))
    leave = edges.join(members.withColumnRenamed("class_name", "src"), "src")
    counts = roles.groupBy("layer").agg(F.count("*").alias("class_count"), F.count_distinct(F.when(F.col("package") != "", F.col("package"))).alias("packages"))
    out = counts.join(enter.groupBy("layer").agg(F.count("*").alias("inbound")), "layer", "left").join(leave.groupBy("layer").agg(F.count("*").alias("outbound")), "layer", "left").na.fill(0, ["inbound", "outbound"])
    return out.select(place, "layer", "class_count", "packages", "inbound", "outbound")


def modules(roles: DataFrame, base: str) -> DataFrame:
    found = A.modules(roles, base)
    return found.select("module", F.concat(F.lit(base + "."), "module").alias("root_package"), "members", "roles", "is_full_stack")


def patterns(roles: DataFrame) -> DataFrame:
    """One row: the entry point, counts and flags of framework use."""
    has = lambda *names: F.coalesce(F.max(F.arrays_overlap("annotations", F.array(*map(F.lit, names)))), F.lit(False))
    count = lambda condition: F.count_if(condition)
    role = F.col("role")
    main = F.min_by(F.struct("class_name", "package"), F.when(role == "main", F.struct(*ORDER)))
    return roles.agg(
        main["class_name"].alias("entry_point"), main["package"].alias("main_package"),
        count((role == "controller") & F.arrays_overlap("annotations", F.array(F.lit("RestController"), F.lit("RequestMapping")))).alias("rest_controllers"),
        count(role == "entity").alias("entities"), count((role == "repository") & ((F.col("detection_method") == "interface") | F.array_contains("annotations", "Repository"))).alias("spring_data"),
        (F.coalesce(F.max(role == "security"), F.lit(False)) | has("EnableWebSecurity", "PreAuthorize", "Secured")).alias("has_security"), has("Scheduled").alias("has_scheduling"), has("Async", "EnableAsync").alias("has_async"), count(role == "dto").alias("dtos"),
    )


def pattern_lines(facts: DataFrame) -> DataFrame:
    """(k, line): what ``patterns`` found, in words."""
    say = lambda k, when, *values: F.when(when, F.struct(F.lit(k).alias("k"), F.format_string(PATTERN_TEXTS[k], *values).alias("line")))
    found = F.array(
        say(0, F.col("entry_point").isNotNull(), "entry_point"), say(1, F.col("rest_controllers") > 0, "rest_controllers"), say(2, F.col("entities") > 0, "entities"), say(3, F.col("spring_data") > 0, "spring_data"),
        say(4, F.col("has_security")), say(5, F.col("has_scheduling")), say(6, F.col("has_async")), say(7, F.col("dtos") > 0, "dtos"),
    )
    return facts.select(F.inline(F.array_compact(found)))


def stats(roles: DataFrame, base: str) -> DataFrame:
    """One row: the base package (the main class's, if there is one) and totals; modules are those under the common base."""
    facts = patterns(roles).select(F.coalesce("main_package", F.lit(base)).alias("base_package"))
    known = F.count_if(F.col("role") != "unknown")
    totals = roles.agg(
        F.count("*").alias("total_classes"), known.alias("detected_classes"), F.count_if(F.col("role") == "unknown").alias("unknown_classes"),
        F.round(F.coalesce(F.try_divide(known, F.count("*")), F.lit(0.0)), 3).alias("detection_rate"), F.count_distinct("layer").alias("layer_count"), F.count_distinct("role").alias("role_count"),
    )
    return facts.crossJoin(totals).crossJoin(modules(roles, base).agg(F.count("*").alias("module_count")))


def framework(parsed: DataFrame, roles: DataFrame) -> DataFrame:
    """One row, framework: told from features, annotations and imports of all files."""
    facts = patterns(roles).select(
        F.col("entry_point").isNotNull().alias("main"),
        ((F.col("rest_controllers") > 0).cast("int") + (F.col("spring_data") > 0).cast("int") + (F.col("entities") > 0).cast("int") + F.col("has_security").cast("int") + F.col("has_scheduling").cast("int") + F.col("has_async").cast("int")).alias("features"),
    )
    marks = parsed.select(F.explode("annotations").alias("a")).where(F.col("a").isin(*FRAMEWORK_ANNOTATIONS)).agg(F.count_distinct("a").alias("marks"), F.coalesce(F.max(F.col("a").isin(*CORE_BOOT)), F.lit(False)).alias("core"))
    taken = F.exists("imports", lambda i: reduce(lambda a, b: a | b, map(i.startswith, FRAMEWORK_IMPORTS)))
    imports = parsed.agg(F.coalesce(F.max(taken), F.lit(False)).alias("imported"))
    kind = (
        F.when(F.col("main") | (F.col("features") >= 2), "Spring Boot")
        .when((F.col("marks") >= 3) | ((F.col("marks") >= 1) & F.col("imported")), F.when(F.col("core"), "Spring Boot").otherwise("Spring"))
        .when(F.col("imported") | (F.col("marks") >= 1), "Spring").otherwise("Java")
    )
    return facts.crossJoin(marks).crossJoin(imports).select(kind.alias("framework"), "features", "marks", "imported")


def container_text(roles: DataFrame, app: str) -> DataFrame:
    """The containers of an application and how they relate."""
    count = lambda r: F.count_if(F.col("role") == r)
    facts = roles.agg(count("controller").alias("c"), count("service").alias("s"), count("repository").alias("r"), count("entity").alias("e"), F.coalesce(F.max(F.contains("class_name", F.lit("Redis"))), F.lit(False)).alias("redis"))
    parts = ((CONTAINER_MAIN, "always"), (CONTAINER_STORE, "e"), (CONTAINER_CACHE, "redis"), (CONTAINER_TAIL, "always"))
    text = [(part, k, t.replace("{app}", app), needs) for part, (many, needs) in enumerate(parts) for k, t in enumerate(many)]
    table = roles.sparkSession.createDataFrame(text, "part int, k long, t string, needs string").crossJoin(F.broadcast(facts))
    number = F.when((F.col("part") == 0) & (F.col("k") == 9), F.col("c")).when((F.col("part") == 0) & (F.col("k") == 10), F.col("s")).when((F.col("part") == 0) & (F.col("k") == 11), F.col("r")).otherwise(F.col("e"))
    shown = (F.col("needs") == "always") | ((F.col("needs") == "e") & (F.col("e") > 0)) | ((F.col("needs") == "redis") & F.col("redis"))
    return table.where(shown).select("part", "k", F.replace("t", F.lit("%d"), number.cast("string")).alias("line"))


def component_text(roles: DataFrame, layer: str, most: int = 5) -> DataFrame:
    """(part, key, k, line): a layer's totals and each of its classes by name."""
    own = roles.where(F.col("layer") == layer)
    packages = own.select("package").distinct().orderBy("package").limit(most).agg(F.array_join(F.array_sort(F.collect_list("package")), ", ").alias("packages"))
    facts = own.agg(F.count("*").alias("n")).crossJoin(packages)
    head = F.array(F.lit(BAR), F.lit(f"  C4 Model -- Level 3: Component ({layer} Layer)"), F.lit(BAR), F.lit(""), F.lit(f"Layer: {layer}"), F.format_string("Classes: %d", "n"), F.concat(F.lit("Packages: "), "packages"), F.lit(""), F.lit("Components:"))
    marks = F.when(F.size("annotations") > 0, F.concat(F.lit(" [@"), F.array_join(F.slice("annotations", 1, 3), ", @"), F.lit("]"))).otherwise("")
    each = F.array(
        F.concat(F.lit("  [Component]  "), "class_name", marks), F.concat(F.lit("               Package: "), "package"),
        F.format_string("               Methods: %d  Detection: %s (%s)", "n_methods", "detection_method", "confidence"), F.lit(""),
    )
    top = facts.select(F.lit(0).alias("part"), F.lit("").alias("key"), F.posexplode(head).alias("k", "line"))
    return top.unionByName(own.select(F.lit(1).alias("part"), F.concat("class_name", F.lit(" "), "package").alias("key"), F.posexplode(each).alias("k", "line")))


def summaries(roles: DataFrame, base: str) -> DataFrame:
    """(name, text): six short texts made of totals and first names."""
    count = lambda r: F.count_if(F.col("role") == r)
    first = lambda r, other: first_of(roles, r, other)
    facts = roles.agg(count("controller").alias("c"), count("service").alias("s"), count("repository").alias("r"), count("unknown").alias("u"), F.count("*").alias("n"), first("controller", "the controllers").alias("fc"), first("service", "the services").alias("fs"), first("main", "").alias("fm"))
    place = lambda c: F.array_position(F.array(*map(F.lit, LAYERS)), c)
    names = roles.select("layer").distinct().agg(F.transform(F.array_sort(F.collect_list(F.struct(place(F.col("layer")).alias("p"), "layer"))), lambda s: s["layer"]).alias("layers"))
    found = modules(roles, base)
    some = found.orderBy("module").limit(8).agg(F.array_join(F.array_sort(F.collect_list("module")), ", ").alias("modules"))
    counts = found.agg(F.count("*").alias("m"), F.count_if("is_full_stack").alias("full"))
    said = pattern_lines(patterns(roles)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "; ").alias("patterns"))
    unknown = roles.where("role = 'unknown'").orderBy(*ORDER).limit(3).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "class_name"))), lambda s: s["class_name"]), ", ").alias("strange"))
    one = facts.crossJoin(names).crossJoin(some).crossJoin(counts).crossJoin(said).crossJoin(unknown)
    joined = lambda sep, *parts: F.array_join(F.array_compact(F.array(*parts)), sep)
    entry = joined("; ", F.when(F.col("fm") != "", F.concat(F.lit("main: "), "fm")), F.when(F.col("c") > 0, F.concat(F.lit("controller: "), "fc")), F.when(F.col("s") > 0, F.concat(F.lit("service: "), "fs")))
    text = lambda name, *values: F.format_string(SUMMARY_TEXTS[name], *values)
    issues = joined("; ", F.when(F.col("u") > 0, text("unclassified", "u", "strange")), F.when(F.col("m") == 0, text("flat")))
    texts = {
        "layer_summary": text("layer_summary", F.size("layers"), F.array_join("layers", ", "), "c", "s", "r"),
        "module_summary": F.when(F.col("m") > 0, F.concat(text("modules", "m"), F.when(F.col("full") > 0, text("full_stack", "full")).otherwise(""), text("module_names", "modules"))).otherwise(text("no_modules")),
        "spring_patterns": F.when(F.col("patterns") != "", text("patterns", "patterns")).otherwise(text("no_patterns")),
        "onboarding_intro": text("onboarding_intro", F.when(F.col("fm") != "", F.col("fm")).otherwise("the main Application class"), "n", "fc", "fs", F.array_join(F.slice("layers", 1, 3), ", ")),
        "quick_start": text("quick_start", entry),
        "critique": F.when(issues != "", text("issues", issues)).otherwise(text("no_issues")),
    }
    return one.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("text")) for k, v in texts.items()))))


def layer_detail(roles: DataFrame, name: str) -> DataFrame:
    """(part, key, line): the classes of a layer, or the layers that there are."""
    own = roles.where(F.col("layer") == name)
    if own.isEmpty():
        return roles.select(F.lit(0).alias("part"), F.col("layer").alias("key"), F.concat(F.lit("Available: "), "layer").alias("line")).distinct()
    marks = F.when(F.size("annotations") > 0, F.concat(F.lit(" [@"), F.array_join(F.slice("annotations", 1, 3), ","), F.lit("]"))).otherwise("")
    head = own.agg(F.count("*").alias("n")).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.format_string("Layer: %s (%d classes)", F.lit(name), "n").alias("line"))
    return head.unionByName(own.select(F.lit(1).alias("part"), F.concat("class_name", F.lit(" "), "package").alias("key"), F.concat(F.lit("  "), "class_name", marks, F.lit(" in "), "package").alias("line")))


def module_detail(roles: DataFrame, base: str, name: str) -> DataFrame:
    """(part, key, line): the classes of a module, or the modules that there are."""
    found = modules(roles, base)
    one = found.where(F.col("module") == name)
    if one.isEmpty():
        return found.select(F.lit(0).alias("part"), F.col("module").alias("key"), F.concat(F.lit("Available: "), "module").alias("line"))
    head = F.array(F.concat(F.lit("Module: "), "module"), F.concat(F.lit("Root Package: "), "root_package"), F.concat(F.lit("Full Stack: "), F.when(F.col("is_full_stack"), "yes").otherwise("no")), F.concat(F.lit("Roles: "), "roles"))
    top = one.select(F.posexplode(head).alias("k", "line")).select(F.lit(0).alias("part"), F.col("k").cast("string").alias("key"), "line")
    own = roles.where(F.col("package").startswith(base) & (F.get(F.split("package", r"\."), F.lit(len(base.split(".")))) == name))
    return top.unionByName(own.select(F.lit(1).alias("part"), F.concat("class_name", F.lit(" "), "package").alias("key"), F.format_string("  %s (%s)", "class_name", "role").alias("line")))


def role_lines(roles: DataFrame, most: int = 5) -> DataFrame:
    """(part, key, line): roles with their first classes by name, most classes first."""
    first = top_per_group(roles, ["role"], [F.col("class_name"), F.col("package")], most).groupBy("role").agg(F.array_join(F.array_sort(F.collect_list("class_name")), ", ").alias("names"))
    counts = roles.groupBy("role").agg(F.count("*").alias("n")).join(first, "role")
    line = F.concat(F.format_string("  %-25s (%3d): ", lookup(ROLE_LABELS, "role"), "n"), "names", more(F.col("n"), most, " +%d more"))
    return counts.select(F.lit(1).alias("part"), F.concat(F.lpad((F.lit(1 << 30) - F.col("n")).cast("string"), 12, "0"), F.lit(" "), "role").alias("key"), line.alias("line"))


#: Names that the whole report tells of a layer and of a role.  Fixed values.
LAYER_NAMES, ROLE_NAMES = 8, 5


def report_lines(roles: DataFrame, base: str) -> DataFrame:
    """(part, key, line): base package, layers with their first classes, modules, patterns and roles, most classes first."""
    spark = roles.sparkSession
    named = lambda most: F.concat(F.array_join("names", ", "), more(F.col("n"), most, " (+%d more)"))
    titled = lambda part, *texts: spark.createDataFrame([(part, f"{k:03d}", t) for k, t in enumerate(texts)], "part int, key string, line string")
    rows = lambda df, part, key, line: df.select(F.lit(part).alias("part"), key.cast("string").alias("key"), line.alias("line"))
    top = roles.agg(F.count("*").alias("n")).select(F.posexplode(F.array(F.lit(f"Base Package: {base or 'unknown'}"), F.format_string("Total Classes: %d", "n"))).alias("k", "line"))
    by_role = heads(roles.where("role <> 'unknown'"), "role", ROLE_NAMES)
    full = F.when(F.col("is_full_stack"), "(full-stack)").otherwise("")
    return union(
        rows(top, 0, F.col("k"), F.col("line")),
        titled(1, "", "Layers:"), rows(layer_heads(roles, LAYER_NAMES, ()), 2, F.lpad(F.col("place").cast("string"), 3, "0"), F.concat(F.format_string("  %s (%d): ", "layer", "n"), named(LAYER_NAMES))),
        titled(3, "", "Modules:"), rows(modules(roles, base), 4, F.col("module"), F.concat(F.format_string("  %s: %d classes [", "module", "members"), F.replace("roles", F.lit(","), F.lit(", ")), F.lit("] "), full)),
        titled(5, "", "Spring Boot Patterns:"), rows(pattern_lines(patterns(roles)), 6, F.col("k"), F.concat(F.lit("  - "), "line")),
        titled(7, "", "Role Breakdown:"), rows(by_role, 8, F.concat(F.lpad((F.lit(1 << 30) - F.col("n")).cast("string"), 12, "0"), F.lit(" "), "role"), F.concat(F.lit("  "), lookup(ROLE_LABELS, "role"), F.lit(": "), named(ROLE_NAMES))),
    )


def aspects(roles: DataFrame, nodes: DataFrame, edges: DataFrame, base: str) -> dict:
    """Answers to named questions, each a function of (layer, module) that gives ordered lines (part, key, line)."""
    def layer_rows():
        found = layers(roles, nodes, edges)
        return found.select(F.lit(1).alias("part"), F.lpad(F.col("place").cast("string"), 3, "0").alias("key"), F.format_string("  %-20s %3d class(es)", "layer", "class_count").alias("line"))

    def module_rows():
        full = F.when(F.col("is_full_stack"), " [full-stack]").otherwise("")
        return modules(roles, base).select(F.lit(1).alias("part"), F.col("module").alias("key"), F.concat(F.format_string("  %-20s %3d classes  roles: ", "module", "members"), F.replace("roles", F.lit(","), F.lit(", ")), full).alias("line"))

    def fact_rows(facts: DataFrame, names: tuple):
        pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.concat(F.lit(f"  {n}: "), F.coalesce(F.col(n).cast("string"), F.lit("-"))).alias("line")) for n in names))
        return facts.select(F.lit(1).alias("part"), F.inline(pairs))

    return {
        "summary": lambda layer="", module="": fact_rows(stats(roles, base), ("base_package", "total_classes", "detected_classes", "unknown_classes", "module_count")),
        "layers": lambda layer="", module="": layer_rows(),
        "modules": lambda layer="", module="": module_rows(),
        "spring_patterns": lambda layer="", module="": pattern_lines(patterns(roles)).select(F.lit(1).alias("part"), F.col("k").cast("string").alias("key"), F.concat(F.lit("  + "), "line").alias("line")),
        "roles": lambda layer="", module="": role_lines(roles),
        "layer_detail": lambda layer="", module="": layer_detail(roles, layer),
        "module_detail": lambda layer="", module="": module_detail(roles, base, module),
        "health": lambda layer="", module="": fact_rows(stats(roles, base), ("total_classes", "detected_classes", "unknown_classes", "detection_rate")),
    }
