"""A review as an object: facts, categories, top issues and full findings, told as text, as JSON, or kept in files.

``findings`` are those of ``rules.findings``; ``described`` gives each a description and a
recommendation by its rule, and the files, classes and methods that it is about.  The text and
the JSON are ordered rows, a line or an object each, so a report has no largest size; what is
one object (the facts) holds seven categories and five issues at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.operators import reports, rules
from lithograph.sources import metadata

#: Rule -> what is wrong, and what to do about it.
WORDING = {
    "SOLID-O001": ("Behaviour is chosen by asking for types, so each new type needs a change here.", "Move the choice into the types, or dispatch on an interface."),
    "SOLID-O002": ("A long chain of alternatives grows with each case.", "Put the cases into a map or into classes of one interface."),
    "SOLID-L001": ("An inherited operation is refused, so the class cannot stand in for its parent.", "Split the interface, or give the operation a meaning."),
    "SOLID-D002": ("Concrete classes are made inside, so they cannot be replaced.", "Take what is needed in the constructor."),
    "SOLID-S001": ("So many methods seldom serve one purpose.", "Split the class by what its methods are for."),
    "SOLID-S002": ("The file is long, which makes it hard to read and to test.", "Move groups of methods that belong together into classes of their own."),
    "SEC-001": ("A query is put together from text that may come from outside.", "Bind values as parameters."),
    "SEC-002": ("A secret stands in the source and in its history.", "Read it from a secret store, and change it."),
    "SEC-004": ("A log line may hold a secret.", "Leave it out of the log, or mask it."),
    "SEC-005": ("The algorithm is broken or close to it.", "Use SHA-256 or AES-GCM."),
    "SEC-006": ("The numbers can be guessed.", "Use SecureRandom."),
    "SEC-007": ("Reading objects from outside can run code.", "Read a plain format, or allow named classes only."),
    "SEC-008": ("A path is made from a request.", "Resolve it below a fixed folder and check that it stays there."),
    "SEC-009": ("Nothing here says who may call.", "Say it on the methods, or note where it is said."),
    "SEC-010": ("Requests from other sites are accepted.", "Leave the protection on for sessions in browsers."),
    "PERF-001": ("One query is made for each element of a loop.", "Fetch all of them with one query."),
    "PERF-003": ("A whole table is read into memory.", "Read it page by page."),
    "PERF-004": ("Relations are read whether they are needed or not.", "Read them when they are asked for."),
    "PERF-005": ("Each round copies all of the text so far.", "Collect the parts in a builder."),
    "MAINT-002": ("The code is nested deeply.", "Return early, and move inner blocks into methods."),
    "MAINT-004": ("An error is swallowed.", "Handle it, or let it pass."),
    "DEBT-001": ("Notes about open work stand in the code.", "Do it, or move it to the list of work."),
    "ANTI-001": ("The class does far too much.", "Divide it by responsibility, one step at a time."),
}
#: For rules without words of their own, by category.
DEFAULT_WORDING = {
    "solid": ("The design makes a later change harder.", "Give the class one reason to change."), "security": ("This can be misused from outside.", "Check who can reach it, and with what."),
    "performance": ("This costs more than it needs to.", "Measure it, then do less of it."), "maintainability": ("This is hard to read.", "Make it simpler, and name what it does."),
    "duplicates": ("The same thing is written twice.", "Keep one of them."), "tech_debt": ("Something was left for later.", "Plan it, or remove it."), "patterns": ("A known structure is used here.", "Keep to it, and say so."),
}

#: Characters that are told of a description, an evidence in text, an evidence in JSON; classes and issues that are told.
TEXT_CHARS, EVIDENCE_CHARS, JSON_EVIDENCE_CHARS = 200, 150, 500
TEXT_CLASSES, ISSUES = 4, 5
RULE, UNDER = "=" * 62, "-" * 40

FINDING = "rule_id string, category string, severity string, title string, description string, recommendation string, affected_files array<string>, affected_classes array<string>, affected_methods array<string>, evidence string"
FACTS = "repository_path string, reviewed_files long, total_classes long, total_findings long, quality_score double, grade string, summary string, top_issues array<string>, generated_at string, category_summaries array<struct<category string, total long, critical long, high long, medium long, low long>>"


def _words(place: int) -> Column:
    """Of the wording of a finding's rule, or of its category: 0 what is wrong, 1 what to do."""
    table = lambda d: F.create_map(*(F.lit(x) for k, v in d.items() for x in (k, v[place])))
    return F.coalesce(table(WORDING)[F.col("rule_id")], table(DEFAULT_WORDING)[F.col("category")], F.lit(""))


def described(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``found`` with description, recommendation, and what it affects; files: (unit, file, methods) where they are known."""
    seen = F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit(" First: "), "evidence")).otherwise("")
    told = F.concat(_words(0), F.lit(" Seen "), F.col("hits").cast("string"), F.lit(" time(s) in "), F.col("unit").cast("string"), F.lit("."), seen)
    rows = found.withColumns({"description": told, "recommendation": _words(1)})
    if files is None:
        rows = rows.withColumns({"affected_files": F.array().cast("array<string>"), "affected_methods": F.array().cast("array<string>")})
    else:
        known = files.select("unit", F.array("file").alias("affected_files"), "methods").withColumnRenamed("methods", "affected_methods")
        none = F.array().cast("array<string>")
        rows = rows.join(known, "unit", "left").withColumns({c: F.coalesce(c, none) for c in ("affected_files", "affected_methods")})
    return rows.withColumn("affected_classes", F.array(F.col("unit").cast("string")))


@dataclass(frozen=True)
class Review:
    """facts: one row of FACTS; findings: rule_seq, unit and the columns of FINDING."""

    facts: DataFrame
    findings: DataFrame

    def text(self) -> DataFrame:
        """(part, severity_rank, rule_seq, unit, k, line): in that order it is the text.

        Parts: 0 the head, 1 the summary, 2 top issues, 3 categories, 4 findings by severity.
        """
        row = self.facts
        head = F.array(
            F.lit(RULE), F.lit("  CODE REVIEW REPORT"), F.lit(RULE), F.concat(F.lit("Repository    : "), "repository_path"), F.format_string("Files Reviewed: %d", "reviewed_files"), F.format_string("Total Classes : %d", "total_classes"),
            F.format_string("Total Findings: %d", "total_findings"), F.format_string("Quality Score : %.1f/100  (Grade: %s)", "quality_score", "grade"), F.concat(F.lit("Generated At  : "), "generated_at"), F.lit(""),
        )
        whole = lambda part, lines: row.select(F.lit(part).alias("part"), F.posexplode(lines).alias("k", "line"))
        titled = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title), F.lit(UNDER)), lines, F.array(F.lit("")))).otherwise(F.array().cast("array<string>"))
        issues = F.transform("top_issues", lambda issue, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), issue))
        order = F.array_sort(F.transform(F.filter("category_summaries", lambda c: c["total"] > 0), lambda c: F.struct((-c["total"]).alias("less"), c["category"].alias("category"), c["total"].alias("total"), c["critical"].alias("critical"), c["high"].alias("high"), c["medium"].alias("medium"), c["low"].alias("low"))))
        categories = F.transform(order, lambda c: F.format_string("  %-22s %3d total  (CRITICAL:%d  HIGH:%d  MEDIUM:%d  LOW:%d)", c["category"], c["total"], c["critical"], c["high"], c["medium"], c["low"]))
        top = whole(0, head).unionByName(whole(1, F.array(F.lit("EXECUTIVE SUMMARY"), F.lit(UNDER), F.col("summary"), F.lit(""))))
        top = top.unionByName(whole(2, titled("TOP ISSUES", issues))).unionByName(whole(3, titled("FINDINGS BY CATEGORY", categories)))
        top = top.select("part", F.lit(0).alias("severity_rank"), F.lit(-1).alias("rule_seq"), F.lit("").alias("unit"), "k", "line")
        rank = rules.severity_order().cast("int")
        heads = self.findings.groupBy("severity").agg(F.count("*").alias("n")).select(rank.alias("severity_rank"), F.lit(-1).alias("rule_seq"), F.lit("").alias("unit"), F.posexplode(F.array(F.format_string("%s FINDINGS (%d)", F.upper("severity"), "n"), F.lit(UNDER))).alias("k", "line"))
        body = F.array_compact(F.array(
            F.concat(F.lit("  ["), "rule_id", F.lit("] "), "title"), F.concat(F.lit("    Category : "), "category"), F.concat(F.lit("    Classes  : "), F.array_join(F.slice("affected_classes", 1, TEXT_CLASSES), ", ")),
            F.concat(F.lit("    Desc     : "), F.substring("description", 1, TEXT_CHARS)), F.concat(F.lit("    Fix      : "), F.substring("recommendation", 1, TEXT_CHARS)),
            F.when(F.coalesce("evidence", F.lit("")) != "", F.concat(F.lit("    Evidence : "), F.substring("evidence", 1, EVIDENCE_CHARS))), F.lit(""),
        ))
        rows = heads.unionByName(self.findings.select(rank.alias("severity_rank"), "rule_seq", F.col("unit").cast("string").alias("unit"), F.posexplode(body).alias("k", "line")))
        return top.unionByName(rows.select(F.lit(4).alias("part"), "severity_rank", "rule_seq", "unit", "k", "line"))

    def json(self) -> DataFrame:
        """(part, rule_seq, unit, json): the object of the facts (part 0), then an object for each finding."""
        names = [f.split(" ")[0] for f in FINDING.split(", ")]
        item = F.struct(*(F.substring(F.coalesce("evidence", F.lit("")), 1, JSON_EVIDENCE_CHARS).alias("evidence") if n == "evidence" else F.col(n) for n in names))
        facts = self.facts.select(F.lit(0).alias("part"), F.lit(-1).alias("rule_seq"), F.lit("").alias("unit"), F.to_json(F.struct(*self.facts.columns)).alias("json"))
        return facts.unionByName(self.findings.select(F.lit(1).alias("part"), "rule_seq", F.col("unit").cast("string").alias("unit"), F.to_json(item).alias("json")))

    def save(self, path: str) -> None:
        """The JSON below ``path``: facts in one file, findings in as many as they need, in order."""
        rows = self.json()
        metadata.save_lines(rows.where("part = 0"), f"{path}/facts", ["part"], "json")
        metadata.save_lines(rows.where("part = 1"), f"{path}/findings", ["rule_seq", "unit"], "json")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(facts, findings) of a saved review; no rows where there is none."""
    return metadata.load_json(spark, f"{path}/facts", FACTS), metadata.load_json(spark, f"{path}/findings", FINDING)


def review(found: DataFrame, path: str, files: int, classes: int, at: str, sources: DataFrame | None = None) -> Review:
    """The review of a set of findings; ``at`` is the time that it tells."""
    rows = described(found, sources)
    score = rules.quality_score(found, classes)
    summary = reports.executive_summary(found, score, rules.executive_top(found))
    issues = rules.top_issues(found, ISSUES)
    ranked = issues.withColumn("at", F.monotonically_increasing_id())  # the rows of an ordered limit, one partition
    top = ranked.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "issue"))), lambda s: s["issue"]).alias("top_issues"))
    place = F.array_position(F.array(*map(F.lit, rules.CATEGORIES)), F.col("category"))
    held = rules.category_summary(found).select(place.alias("place"), F.struct("category", "total", "critical", "high", "medium", "low").alias("c"))
    categories = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "c"))), lambda s: s["c"]).alias("category_summaries"))
    facts = score.crossJoin(found.agg(F.count("*").alias("total_findings"))).crossJoin(summary).crossJoin(top).crossJoin(categories)
    facts = facts.select(
        F.lit(path).alias("repository_path"), F.lit(files).cast("long").alias("reviewed_files"), F.lit(classes).cast("long").alias("total_classes"), "total_findings", F.col("score").alias("quality_score"),
        "grade", "summary", "top_issues", F.lit(at).alias("generated_at"), "category_summaries",
    )
    return Review(facts, rows)
