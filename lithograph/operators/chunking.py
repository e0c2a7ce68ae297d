"""Chunks of source files for retrieval: a summary per type, a chunk per method, or plain windows.

Types and members are those of ``sources.java_types``, nested types among them; texts are cut
from the source as it is.  A method longer than ``most`` is split at blank lines, lines and
spaces, packed greedily.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithograph.functions.values import per_value

SPLIT_SCHEMA = "array<string>"

def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ")) -> list[str]:
    """Pieces of at most ``size`` characters where the separators allow it, packed greedily with overlap.

    A token longer than ``size`` without any separator stays whole.
    """
    sep = next((s for s in separators if s in text), None)
    if len(text) <= size or sep is None:
        return [text] if text.strip() else []
    rest = separators[separators.index(sep) + 1 :]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        joined = sep.join(held).strip()
        if joined:
            out.append(joined)

    for part in text.split(sep):
        if len(part) > size:
            flush()
            held = []
            out.extend(split_text(part, size, overlap, rest))
            continue
        while held and len(sep.join([*held, part])) > size:
            flush()
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def splitter(size: int, overlap: int):
    """Pieces of a column of texts; none of a null one."""
    return per_value(lambda t: split_text(t or "", size, overlap), SPLIT_SCHEMA)


CHUNK_COLUMNS = ("file_path", "package", "class_name", "annotations", "method", "method_annotations", "chunk_type", "chunk_index", "page_content")


def chunk_files(parsed: DataFrame, most: int = 3000, size: int = 1500, overlap: int = 200) -> DataFrame:
    """(chunk_id, file_path, package, class_name, annotations, method, method_annotations, chunk_type, chunk_index, page_content).

    Index 0 is a type's summary (fields, then signatures); its methods and constructors follow from 1;
    parts of a long one have index * 1000 + part; files without a type become plain windows.  Members
    of an enumeration give no chunks.  ``chunk_id`` is told from file, kind and index, as an index of
    the files' own; types of one file share it, so the key of a row is (chunk_id, class_name).
    """
    split = splitter(size, overlap)
    joined = lambda c: F.array_join(c, ",")
    nothing = F.lit(None).cast("string")
    # One row a type, or one for a file without any: files are read once for all kinds of chunks.
    rows = parsed.select("file_path", F.coalesce("package", F.lit("")).alias("package"), F.col("annotations").alias("marks"), F.when(F.size("types") == 0, F.col("source")).alias("whole"), F.explode_outer("types").alias("t"))
    prefix = F.concat(
        F.when(F.col("package") != "", F.concat(F.lit("// package: "), "package", F.lit("\n"))).otherwise(""),
        F.when(F.size("t.annotations") > 0, F.concat(F.lit("// class annotations: "), F.array_join("t.annotations", ", "), F.lit("\n"))).otherwise(""),
        F.lit("// "), F.col("t.header"), F.lit("\n"),
    )
    plain = F.col("t").isNull()
    own = F.when(F.col("t.kind") == "enum", F.slice("t.members", 1, 0)).otherwise(F.col("t.members"))
    rows = rows.withColumns({"own": own, "head": F.when(plain, "").otherwise(prefix), "class_name": F.col("t.name"), "annotations": joined(F.when(plain, F.col("marks")).otherwise(F.col("t.annotations")))})
    fields = F.transform(F.filter("own", lambda m: m["kind"] == "field"), lambda m: F.concat(F.lit("    "), m["text"]))
    calls = F.filter("own", lambda m: m["kind"] != "field")
    lines = F.array_join(F.concat(fields, F.transform(calls, lambda m: F.concat(F.lit("    "), m["signature"], F.lit(";")))), "\n")

    def unit(method, method_annotations, kind: str, k, text):
        return F.struct(method.alias("method"), method_annotations.alias("method_annotations"), F.lit(kind).alias("chunk_type"), k.cast("int").alias("k"), text.alias("text"))

    summary = unit(nothing, nothing, "class_summary", F.lit(0), F.concat(F.col("t.header"), F.lit(" {\n"), lines, F.lit("\n}")))
    methods = F.transform(calls, lambda m, i: unit(m["name"], joined(m["annotations"]), "method", i + 1, m["text"]))
    units = F.when(plain, F.array(unit(nothing, nothing, "fallback", F.lit(0), F.col("whole")))).otherwise(F.concat(F.array(summary), methods))
    keep = ("file_path", "package", "class_name", "annotations")
    rows = rows.select(*keep, "head", F.explode(units).alias("u")).select(*keep, "head", "u.*")
    long = (F.col("chunk_type") == "method") & (F.length("text") > most)
    rows = rows.withColumn("long", long).withColumn("pieces", split(F.when(F.col("long") | (F.col("chunk_type") == "fallback"), F.col("text"))))
    whole = ~F.col("long") & (F.col("chunk_type") != "fallback")
    rows = rows.select(*keep, "head", "method", "method_annotations", "chunk_type", "k", "long", F.posexplode(F.when(whole, F.array("text")).otherwise(F.col("pieces"))).alias("part", "piece"))
    out = rows.select(
        *keep, "method", "method_annotations", F.when(F.col("long"), "method_part").otherwise(F.col("chunk_type")).alias("chunk_type"),
        F.when(F.col("long"), F.col("k") * 1000 + F.col("part")).otherwise(F.col("k") + F.col("part")).alias("chunk_index"), F.concat("head", "piece").alias("page_content"),
    )
    return out.select(F.md5(F.concat("file_path", "chunk_type", F.col("chunk_index").cast("string"))).alias("chunk_id"), *CHUNK_COLUMNS)
