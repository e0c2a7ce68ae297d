"""Texts about an architecture, made of small aggregates: context, layers, onboarding notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layers from the outside in.
LAYERS = ("Presentation", "Business", "Persistence", "Data Model", "Data Transfer", "Configuration", "Security", "Cross-cutting", "Bootstrap", "Unknown")


def layer_place(column: str = "layer") -> Column:
    return F.array_position(F.array(*map(F.lit, LAYERS)), F.col(column))


def _joined(key, line: Column, separator: str = "\n") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), line.alias("line")))), lambda s: s["line"]), separator)


def layer_lines(roles: DataFrame, padded: Callable[[Column], Column] = lambda n: F.format_string("%5d", n)) -> DataFrame:
    """One row, text: a line per layer that has classes, outside in; ``padded`` writes their number."""
    counts = roles.groupBy("layer").agg(F.count("*").alias("n"), F.countDistinct("package").alias("packages"))
    line = F.format_string("%-14s %s classes in %d packages", "layer", padded(F.col("n")), "packages")
    return counts.agg(_joined(layer_place(), line).alias("text"))


def context_text(roles: DataFrame, app: str) -> DataFrame:
    """One row, text: who uses the system and what it keeps."""
    has = lambda r: F.max(F.col("role") == r)
    facts = roles.agg(F.count("*").alias("n"), has("controller").alias("web"), has("repository").alias("data"))
    parts = F.array_compact(F.array(
        F.format_string("System: %s (%d classes)", F.lit(app), "n"),
        F.when(F.col("web"), F.lit("User -> " + app + ": requests")),
        F.when(F.col("data"), F.lit(app + " -> Database: reads and writes")),
    ))
    return facts.select(F.array_join(parts, "\n").alias("text"))


def onboarding(roles: DataFrame, app: str, most: int = 5) -> DataFrame:
    """One row, markdown: a section per role with its first classes and how many more there are."""
    names = F.array_sort(F.collect_set("class_name"))
    groups = roles.groupBy("role").agg(names.alias("names"))
    more = F.size("names") - most
    line = F.concat(
        F.lit("## "), F.initcap("role"), F.lit(" ("), F.size("names").cast("string"), F.lit(")\n"), F.array_join(F.slice("names", 1, most), ", "),
        F.when(more > 0, F.format_string(" +%d more", more)).otherwise(""),
    )
    return groups.agg(F.concat(F.lit(f"# {app}\n\n"), _joined(F.col("role"), line, "\n\n")).alias("markdown"))


def app_name(base: Column) -> Column:
    """The last segment of a package as a name."""
    return F.initcap(F.regexp_replace(F.element_at(F.split(base, r"\."), -1), r"[-_]", " "))
