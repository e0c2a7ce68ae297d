"""Architecture classification: roles, layers, modules, package trees and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What decides a class's role, in this order: annotation, interface, name suffix, package segment.
ANNOTATION_ROLES = {
    "RestController": ("controller", "high"), "Controller": ("controller", "high"), "RequestMapping": ("controller", "medium"), "Service": ("service", "high"), "Repository": ("repository", "high"),
    "Entity": ("entity", "high"), "Table": ("entity", "high"), "Document": ("entity", "high"), "MappedSuperclass": ("entity", "high"), "Embeddable": ("entity", "medium"),
    "Configuration": ("configuration", "high"), "SpringBootApplication": ("main", "high"), "EnableAutoConfiguration": ("main", "high"), "Component": ("component", "medium"),
    "Mapper": ("component", "medium"), "Aspect": ("component", "medium"), "EventListener": ("component", "medium"), "Scheduled": ("component", "medium"),
}
REPOSITORY_INTERFACES = ("JpaRepository", "CrudRepository", "PagingAndSortingRepository", "MongoRepository", "ReactiveMongoRepository", "R2dbcRepository", "ElasticsearchRepository", "ReactiveCrudRepository")
SUFFIX_ROLES = {
    "Controller": "controller", "Resource": "controller", "Endpoint": "controller", "Service": "service", "ServiceImpl": "service", "Facade": "service", "Repository": "repository", "RepositoryImpl": "repository",
    "Dao": "repository", "DAO": "repository", "Store": "repository", "Entity": "entity", "DTO": "dto", "Dto": "dto", "Request": "dto", "Response": "dto", "Payload": "dto", "Form": "dto", "Config": "configuration",
    "Configuration": "configuration", "Properties": "configuration", "Settings": "configuration", "Exception": "exception", "Error": "exception", "Util": "utility", "Utils": "utility", "Helper": "utility",
    "Constants": "utility", "Constant": "utility",
}
PACKAGE_ROLES = {
    "controller": "controller", "controllers": "controller", "web": "controller", "rest": "controller", "api": "controller", "resource": "controller", "service": "service", "services": "service", "business": "service",
    "repository": "repository", "repositories": "repository", "repo": "repository", "dao": "repository", "persistence": "repository", "entity": "entity", "entities": "entity", "domain": "entity", "model": "entity",
    "models": "entity", "dto": "dto", "dtos": "dto", "transfer": "dto", "request": "dto", "response": "dto", "config": "configuration", "configuration": "configuration", "exception": "exception",
    "exceptions": "exception", "util": "utility", "utils": "utility", "common": "utility", "shared": "utility", "security": "security", "auth": "security",
}
ROLE_LAYER = {
    "controller": "Presentation", "service": "Business", "repository": "Persistence", "entity": "Data Model", "dto": "Data Transfer", "configuration": "Configuration", "component": "Business",
    "security": "Security", "exception": "Cross-cutting", "utility": "Cross-cutting", "main": "Bootstrap", "unknown": "Unknown",
}


def _map(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))


def classify(classes: DataFrame) -> DataFrame:
    """``classes`` (class_name, package, annotations, interfaces) with role, layer, confidence and detection_method."""
    roles = _map({k: v[0] for k, v in ANNOTATION_ROLES.items()})
    sure = _map({k: v[1] for k, v in ANNOTATION_ROLES.items()})
    known = F.get(F.filter("annotations", lambda a: roles[a].isNotNull()), F.lit(0))
    by_interface = F.arrays_overlap(F.transform("interfaces", lambda i: F.trim(F.substring_index(i, "<", 1))), F.array(*map(F.lit, REPOSITORY_INTERFACES)))
    by_suffix = None
    for suffix in sorted(SUFFIX_ROLES, key=lambda s: (-len(s), s)):  # the longest first
        fits = F.col("class_name").endswith(suffix) & (F.length("class_name") > len(suffix))
        by_suffix = F.when(fits, SUFFIX_ROLES[suffix]) if by_suffix is None else by_suffix.when(fits, SUFFIX_ROLES[suffix])
    hints = _map(PACKAGE_ROLES)
    segments = F.reverse(F.split(F.lower(F.coalesce("package", F.lit(""))), r"\."))
    by_package = F.get(F.filter(F.transform(segments, lambda s: hints[s]), lambda r: r.isNotNull()), F.lit(0))
    out = classes.withColumns({"_known": known, "_interface": F.coalesce(by_interface, F.lit(False)), "_suffix": by_suffix, "_package": by_package})
    method = F.when(F.col("_known").isNotNull(), "annotation").when(F.col("_interface"), "interface").when(F.col("_suffix").isNotNull(), "naming").when(F.col("_package").isNotNull(), "package").otherwise("unknown")
    out = out.withColumn("detection_method", method)
    pick = lambda *v: F.when(F.col("detection_method") == "annotation", v[0]).when(F.col("detection_method") == "interface", v[1]).when(F.col("detection_method") == "naming", v[2]).when(F.col("detection_method") == "package", v[3])
    out = out.withColumn("role", pick(roles[F.col("_known")], F.lit("repository"), F.col("_suffix"), F.col("_package")).otherwise("unknown"))
    out = out.withColumn("confidence", pick(sure[F.col("_known")], F.lit("high"), F.lit("medium"), F.lit("low")).otherwise("low"))
    return out.withColumn("layer", _map(ROLE_LAYER)[F.col("role")]).drop("_known", "_interface", "_suffix", "_package")


def explode_types(files: DataFrame) -> DataFrame:
    """One row per class or interface of a file; of equal (package, name) the first file in path order."""
    rows = files.select("file_path", F.coalesce("package", F.lit("")).alias("package"), "annotations", "interfaces", F.explode(F.concat("classes", "interfaces")).alias("class_name"))
    first = rows.groupBy("package", "class_name").agg(F.min_by(F.struct("file_path", "annotations", "interfaces"), "file_path").alias("r"))
    return first.select("class_name", "package", "r.*")


def base_package(packages: DataFrame) -> DataFrame:
    """One row, base: the longest common dotted prefix of all non-empty packages."""
    rows = packages.where("package <> ''").select("package").distinct()
    # A common prefix of all is one of the least and the greatest package, segment by segment.
    ends = rows.agg(F.min(F.split("package", r"\.")).alias("a"), F.max(F.split("package", r"\.")).alias("b"))
    same = F.transform(F.arrays_zip("a", "b"), lambda p: F.coalesce(p["a"] == p["b"], F.lit(False)))
    run = F.array_position(F.array_append(same, F.lit(False)), False).cast("int") - 1
    return ends.select(F.coalesce(F.array_join(F.slice("a", F.lit(1), run), "."), F.lit("")).alias("base"))


def package_parents(packages: DataFrame) -> DataFrame:
    """(package, parent): the nearest existing proper ancestor, '' for roots; ancestors are looked up by equality."""
    own = packages.select("package").distinct()
    parts = F.split("package", r"\.")
    above = own.select("package", F.explode_outer(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), ".")))).alias("parent"))
    found = above.join(own.select(F.col("package").alias("parent")), "parent", "left_semi")
    nearest = found.groupBy("package").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return own.join(nearest, "package", "left").select("package", F.coalesce("parent", F.lit("")).alias("parent"))


def subtree_totals(counts: DataFrame) -> DataFrame:
    """(package, total): sums of n over each package and everything below it, for every dotted prefix."""
    parts = F.split("package", r"\.")
    spread = counts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("package"), "n")
    return spread.groupBy("package").agg(F.sum("n").alias("total"))


def modules(roles: DataFrame, base: str) -> DataFrame:
    """Per segment right after ``base``: members, distinct roles, and whether it has all three main layers."""
    depth = len(base.split(".")) if base else 0
    rows = roles.where(F.col("package").startswith(base)).withColumn("module", F.get(F.split("package", r"\."), F.lit(depth))).where("module <> ''")
    has = lambda r: F.max(F.col("role") == r)
    return rows.groupBy("module").agg(F.count("*").alias("members"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), (has("controller") & has("service") & has("repository")).alias("is_full_stack"))


def dominant(rows: DataFrame, group: str, value: str, order: str | None = None) -> DataFrame:
    """The commonest value of each group; ties go to the first seen in ``order``, or without one to the first in code-point order."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("n"), (F.min(order) if order else F.min(value)).alias("_first"))
    return counts.groupBy(group).agg(F.min_by(value, F.struct(-F.col("n"), "_first", F.col(value))).alias("dominant"), F.max("n").alias("n"))


def patterns(roles: DataFrame) -> DataFrame:
    """One row of counts and flags of framework use."""
    with_ = lambda *names: F.arrays_overlap("annotations", F.array(*map(F.lit, names)))
    role = lambda r: F.count_if(F.col("role") == r)
    return roles.agg(
        F.count("*").alias("total_classes"), role("controller").alias("controllers"), role("service").alias("services"), role("repository").alias("repositories"),
        role("entity").alias("entities"), F.count_if(with_("RestController")).alias("rest_controllers"), F.coalesce(F.max(with_("Transactional")), F.lit(False)).alias("uses_transactions"),
        role("unknown").alias("unknown"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("role") != "unknown"), F.count("*")), F.lit(0.0)), 3).alias("detection_rate"),
    )
