"""A review engine whose rules are data.

A rule finds a unit whose text matches its pattern at least ``least`` times; some count
different matches, need another pattern, or are silent where one is there.  All rules compile
to one projection over the units, so texts are read once.  Findings are filtered,
de-duplicated, scored, graded and summed up by grouped aggregates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.functions.storage import cut

SEVERITIES = ("critical", "high", "medium", "low", "info")
#: The order in which analyzers report.
CATEGORIES = ("solid", "security", "performance", "maintainability", "duplicates", "tech_debt", "patterns")
# The weight of a finding, and the least score of each grade.
WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1, "info": 0}
GRADES = ((90, "A"), (75, "B"), (60, "C"), (45, "D"))


@dataclass(frozen=True)
class Rule:
    rule_id: str
    category: str
    severity: str
    title: str  # with {unit}, {hits} and {values}
    pattern: str
    least: int = 1
    distinct: bool = False  # count different matches
    group: int = 0  # of the pattern, which is counted
    requires: str | None = None
    unless: str | None = None
    needs: str | None = None  # a text that every match holds: looked for first
    exempt: tuple[str, ...] = ()  # matches that end so do not count
    silent: tuple[str, ...] = ()  # matches that begin so do not count
    most: int | None = None  # hits told at most
    worse: tuple[int, str] | None = None  # from so many hits on another severity
    skip_lines: str | None = None  # lines that are not looked at


def _values(r: Rule, content: Column) -> Column:
    if r.skip_lines:
        content = F.array_join(F.filter(F.split(content, "\n"), lambda x: ~x.rlike(r.skip_lines)), "\n")
    found = F.regexp_extract_all(content, F.lit(r.pattern), F.lit(r.group))
    if r.exempt:
        found = F.filter(found, lambda x: ~x.rlike("(?:" + "|".join(r.exempt) + ")$"))
    if r.silent:
        found = F.filter(found, lambda x: ~x.rlike("^(?:" + "|".join(r.silent) + ")"))
    return F.array_distinct(found) if r.distinct else found


def _title(r: Rule, unit: Column, hits: Column, values: Column) -> Column:
    parts = {"{unit}": unit.cast("string"), "{hits}": hits.cast("string"), "{values}": F.array_join(values, ", ")}
    return F.concat(*(parts.get(x, F.lit(x)) for x in re.split(r"(\{\w+\})", r.title) if x))


def findings(units: DataFrame, rules: tuple[Rule, ...], unit: str = "class_name", text: str = "content") -> DataFrame:
    """(unit, rule_seq, rule_id, category, severity, title, hits, evidence), one row per rule that a unit breaks."""
    content = F.coalesce(F.col(text), F.lit(""))
    checks = []
    for seq, r in enumerate(rules):
        values = _values(r, content)
        count = F.size(values)
        hits = F.least(count, F.lit(r.most)) if r.most else count
        broken = count >= r.least
        if r.needs:
            broken = content.contains(r.needs) & broken
        if r.requires:
            broken = broken & content.rlike(r.requires)
        if r.unless:
            broken = broken & ~content.rlike(r.unless)
        severity = F.when(count >= r.worse[0], r.worse[1]).otherwise(r.severity) if r.worse else F.lit(r.severity)
        checks.append(F.when(broken, F.struct(
            F.lit(seq).alias("rule_seq"), F.lit(r.rule_id).alias("rule_id"), F.lit(r.category).alias("category"), severity.alias("severity"),
            _title(r, F.col(unit), hits, values).alias("title"), hits.alias("hits"), F.substring(F.get(values, F.lit(0)), 1, 500).alias("evidence"),
        )))
    return units.select(F.col(unit).alias("unit"), F.inline(F.array_compact(F.array(*checks))))


def chosen(rules: tuple[Rule, ...], categories: str | None) -> tuple[Rule, ...]:
    """The rules of some analyzers, named in a comma-separated list; all of them without one."""
    if not categories:
        return rules
    wanted = {c.strip().lower() for c in categories.split(",")}
    return tuple(r for r in rules if r.category in wanted)


def with_severity(found: DataFrame, *severities: str) -> DataFrame:
    return found.where(F.col("severity").isin(*severities))


def in_category(found: DataFrame, *categories: str) -> DataFrame:
    return found.where(F.col("category").isin(*categories))


def analyzer_order(column: str = "category") -> Column:
    return F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col(column))


def dedup(found: DataFrame) -> DataFrame:
    """The first finding of each rule and set of affected classes (array column ``affected``)."""
    key = F.array_join(F.array_sort(F.array_distinct("affected")), "\u0001")
    first = found.withColumn("_key", key).groupBy("rule_id", "_key").agg(F.min_by(F.struct(*[c for c in found.columns if c != "rule_id"]), F.struct("rule_seq", "unit")).alias("r"))
    return first.select("rule_id", "r.*")


def category_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("category").agg(F.count("*").alias("total"), *(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def quality_score(found: DataFrame, units: int) -> DataFrame:
    """One row: score (100 less weights per ten units, 0 at least) and grade."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("severity")]
    lost = found.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("lost"))
    score = F.round(F.greatest(F.lit(0.0), 100.0 - F.col("lost") / F.lit(max(units / 10, 1.0))), 2) if units else F.lit(100.0)
    out = lost.select(score.alias("score"))
    grade = None
    for least, name in GRADES:
        grade = F.when(F.col("score") >= least, name) if grade is None else grade.when(F.col("score") >= least, name)
    return out.withColumn("grade", grade.otherwise("F"))


def severity_order(column: str = "severity"):
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(column))


def top_issues(found: DataFrame, n: int = 5) -> DataFrame:
    """The first n different (rule, start of title) by severity, then by order of finding."""
    key = F.substring("title", 1, 60)
    first = found.groupBy("rule_id", key.alias("_t")).agg(F.min_by(F.struct("severity", "title", "rule_seq", "unit"), F.struct(severity_order(), "rule_seq", "unit")).alias("r"))
    ordered = first.select("rule_id", "r.*").orderBy(severity_order(), "rule_seq", "unit").limit(n)
    return ordered.select("rule_id", F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "title").alias("issue"))


def executive_top(found: DataFrame, n: int = 3) -> DataFrame:
    """The n categories that weigh most: 10 critical + 5 high + 2 medium."""
    weigh = 10 * F.col("critical") + 5 * F.col("high") + 2 * F.col("medium")
    return category_summary(found).withColumn("priority", weigh).orderBy(F.desc("priority"), "category").limit(n).select("category", "total", "priority")


def line_numbers(units: DataFrame, unit: str, text: str, pattern: str, most: int = 10) -> DataFrame:
    """(unit, lines): numbers of the first lines that match."""
    marked = F.transform(F.split(text, "\n"), lambda x, i: F.when(x.rlike(pattern), i + 1))
    return units.select(F.col(unit), F.slice(F.array_compact(marked), 1, most).alias("lines")).where(F.size("lines") > 0)


# How a public method's signature and a list of implemented interfaces are told from text, and suffixes and names that rules leave out.
SIGNATURE = r"(?:public|protected)\s+(?:static\s+)?(?:final\s+)?([\w<>\[\]]+)\s+(\w+)\s*\(([^)]*)\)"
IMPLEMENTS = r"\bimplements\s+([\w,\s]+)"
STRATEGY_EXEMPT = ("Repository", "Listener")
TEST_SUFFIXES = ("Test", "Tests", "IT")
TESTABLE = ("Service", "RestController", "Controller")
ENTITIES = ("Entity", "Document", "MappedSuperclass")
ACCESSORS = ("get", "set", "is", "has", "equals", "hashcode", "tostring", "canequal")


def signatures(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, signature) of every public or protected method: ``type name(number of parameters)``, generics left out of the type."""
    found = lambda group: F.regexp_extract_all(text, F.lit(SIGNATURE), F.lit(group))
    rows = files.select(key, F.explode(F.arrays_zip(found(1).alias("type"), found(2).alias("name"), found(3).alias("params"))).alias("m"))
    many = F.size(F.filter(F.split("m.params", ","), lambda p: F.trim(p) != ""))
    return rows.select(key, F.concat(F.substring_index("m.type", "<", 1), F.lit(" "), "m.name", F.lit("("), many.cast("string"), F.lit(")")).alias("signature"))


def implementors(parsed: DataFrame) -> DataFrame:
    """(iface, class_name, file_path): every class of a file implements what the file's text says."""
    lists = F.regexp_extract_all("source", F.lit(IMPLEMENTS), F.lit(1))
    names = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda i: F.substring_index(F.regexp_replace(i, r"^\s+|\s+$", ""), "<", 1))))
    rows = parsed.select("file_path", F.explode("classes").alias("class_name"), names.alias("names")).select("file_path", "class_name", F.explode("names").alias("iface"))
    return rows.where("iface <> ''").select("iface", "class_name", "file_path")


def strategy_findings(parsed: DataFrame, least: int = 3) -> DataFrame:
    counts = implementors(parsed).groupBy("iface").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    exempt = F.lit(False)
    for suffix in STRATEGY_EXEMPT:
        exempt = exempt | F.col("iface").endswith(suffix)
    return counts.where(~exempt).select(F.lit("PAT-005").alias("rule_id"), F.lit("info").alias("severity"), F.format_string("Strategy pattern: %s has %d implementations", "iface", "n").alias("title"))


def duplicate_signatures(parsed: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """Findings for the signatures that most classes share; of those with the same classes the first.

    Of classes of one name the last file in path order counts.  A set of classes is told by its size
    and two sums of hashes, so no list of a signature's classes is ever gathered.
    """
    last = parsed.select("file_path", "source", F.explode("classes").alias("class_name")).groupBy("class_name").agg(F.max_by("source", "file_path").alias("source"))
    mark = F.xxhash64("class_name")
    shared = signatures(last, "class_name", "source").groupBy("signature").agg(F.count("*").alias("classes"), F.sum(mark.cast("decimal(38,0)")).alias("a"), F.bit_xor(mark).alias("b")).where(F.col("classes") >= least)
    top = shared.orderBy(F.desc("classes"), "signature").limit(most)
    first = top.groupBy("classes", "a", "b").agg(F.min("signature").alias("signature"))
    return first.select(F.lit("DUP-001").alias("rule_id"), F.lit("low").alias("severity"), F.format_string("Duplicate method signature '%s' in %d classes", "signature", "classes").alias("title"), "classes")


#: Names that a needle meets at one gram in one task at most; where more hold it, they meet in blocks of that many.
GRAM_BLOCK = 65536


def name_grams(names: DataFrame, name: str, widths: list[int]) -> DataFrame:
    """(_name, _gram): every run of as many letters as ``widths`` says, once for each name."""
    length = F.length("_name")

    def runs(width: int) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.greatest(length, F.lit(1))), lambda i: i <= length - width + 1)
        return F.transform(starts, lambda i: F.substr(F.col("_name"), i, F.lit(width)))

    return names.select(F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct().select("_name", F.explode(F.array_distinct(F.flatten(F.array(*map(runs, widths))))).alias("_gram"))


def rarest_grams(needles: DataFrame, index: DataFrame, needle: str, width: int) -> DataFrame:
    """(needle, _gram, _n): of each needle's grams the one that fewest names hold; needles with a gram that no name holds are left out.

    A needle's grams are its runs of ``width`` letters; one that is shorter is its own gram.
    """
    own = F.when(F.length(needle) < width, F.array(needle)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(needle) - width + 1, F.lit(1))), lambda i: F.substr(F.col(needle), i, F.lit(width))))
    grams = needles.select(needle).where(F.col(needle).isNotNull()).distinct().select(needle, F.explode(F.array_distinct(own)).alias("_gram"))
    counts = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    met = grams.join(counts, "_gram", "left").groupBy(needle).agg(F.min_by(F.struct("_gram", "_n"), F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_g"))
    return met.select(needle, "_g._gram", "_g._n").where("_n IS NOT NULL")


def containing(needles: DataFrame, names: DataFrame, needle: str, name: str, width: int = 5, block: int = GRAM_BLOCK) -> DataFrame:
    """(needle) that some name contains; an empty needle is contained in any.

    Each needle is looked up in an index of the names by its rarest gram, so a beginning that a
    whole project shares is no key.  Names of a gram that very many hold meet the needle in blocks.
    """
    wanted = cut(needles.select(needle).where(F.col(needle).isNotNull()).distinct())
    # As many widths as ``width`` at most.
    widths = sorted(r[0] for r in wanted.select(F.least(F.length(needle), F.lit(width))).distinct().collect() if r[0])
    blank = wanted.where(F.col(needle) == "").join(names.where(F.col(name).isNotNull()).select(F.lit("").alias(needle)).limit(1), needle, "left_semi")
    if not widths:
        return blank
    index = cut(name_grams(names, name, widths))
    rare = rarest_grams(wanted.where(F.col(needle) != ""), index, needle, width).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    rare = cut(rare)
    asked = rare.select(needle, "_gram", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block"))
    dealt = index.join(rare.select("_gram", "_blocks").distinct(), "_gram").withColumn("_block", F.pmod(F.xxhash64("_name"), F.col("_blocks")).cast("int"))
    hit = asked.join(dealt.select("_name", "_gram", "_block"), ["_gram", "_block"]).where(F.contains("_name", F.col(needle)))
    return hit.select(needle).distinct().unionByName(blank)


def missing_tests(parsed: DataFrame) -> DataFrame:
    """Services and controllers whose name is in no test class's name."""
    classes = parsed.select("file_path", "annotations", F.explode("classes").alias("class_name"))
    is_test = F.lit(False)
    for suffix in TEST_SUFFIXES:
        is_test = is_test | F.col("class_name").endswith(suffix)
    tests = classes.where(is_test).select(F.col("class_name").alias("test")).distinct()
    units = classes.where(F.arrays_overlap("annotations", F.array(*map(F.lit, TESTABLE))))
    missing = units.join(containing(units, tests, "class_name", "test"), "class_name", "left_anti")
    return missing.select(F.lit("DEBT-007").alias("rule_id"), F.lit("medium").alias("severity"), F.concat(F.lit("No test class found for "), "class_name").alias("title"), "file_path")


#: Sizes from which a class is told of.  Fixed values.
MOST_METHODS, MOST_LINES, LARGE_LINES = 15, 300, 500
GOD_LINES, GOD_METHODS, WORST_LINES, WORST_METHODS = 500, 20, 800, 30


def metadata_findings(parsed: DataFrame, imports: int = 20, domains: int = 4, loc: float = 40, behaviour: int = 3) -> DataFrame:
    """Findings that need no text: many methods, long files, wide imports, entities without behaviour, long methods on average, god classes."""
    domain = F.array_distinct(F.transform(F.filter("imports", lambda i: F.size(F.split(i, r"\.")) >= 2), lambda i: F.substring_index(i, ".", 2)))
    plain = F.filter("methods", lambda m: ~F.lower(m).rlike("^(" + "|".join(ACCESSORS) + ")"))
    average = F.try_divide("lines_of_code", F.size("methods"))
    finding = lambda rule, title, severity="low": F.struct(F.lit(rule).alias("rule_id"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), title.alias("title"))
    rows = parsed.select("imports", "annotations", "methods", "lines_of_code", F.posexplode("classes").alias("place", "class_name")).withColumns({"domains": F.size(domain), "plain": F.size(plain), "average": average, "n": F.size("methods")})
    lines = F.col("lines_of_code")
    checks = F.array(
        F.when(F.col("n") > MOST_METHODS, finding("SOLID-S001", F.format_string("SRP: %s has too many methods (%d)", "class_name", "n"), "medium")),
        F.when(lines > MOST_LINES, finding("SOLID-S002", F.format_string("SRP: %s is too large (%d LOC)", "class_name", lines), F.when(lines > LARGE_LINES, "medium").otherwise("low"))),
        F.when((F.size("imports") > imports) & (F.col("domains") > domains), finding("SOLID-S003", F.format_string("SRP: %s imports from %d domains", "class_name", "domains"))),
        F.when(F.arrays_overlap("annotations", F.array(*map(F.lit, ENTITIES))) & (F.col("plain") <= behaviour), finding("ANTI-003", F.format_string("Anemic Domain Model: %s has no domain behaviour", "class_name"))),
        F.when((F.col("place") == 0) & (F.size("methods") > 0) & (F.col("average") > loc), finding("MAINT-001", F.format_string("Long methods detected in %s (avg ~%.0f LOC)", "class_name", F.bround("average", 0)))),
        F.when((lines >= GOD_LINES) | (F.col("n") >= GOD_METHODS), finding("ANTI-001", F.format_string("God Class anti-pattern: %s (%d LOC, %d methods)", "class_name", lines, "n"), F.when((lines > WORST_LINES) | (F.col("n") > WORST_METHODS), "high").otherwise("medium"))),
    )
    return rows.select(F.inline(F.array_compact(checks)))
