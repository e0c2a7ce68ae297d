"""Documents made of ordered lines: sections by a reader's level, as Markdown rows or a word-processor file.

A section is a table of lines; a document is (section, part, key, line) in that order, written
as text or as a packed file, of any length.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithograph.operators import structure as S

# The sections of a document for each level of reader, in order.
SECTIONS = {
    "beginner": ("overview", "components", "getting_started", "glossary"),
    "intermediate": ("overview", "architecture", "patterns", "components", "modules", "getting_started"),
    "advanced": ("overview", "architecture", "patterns", "components", "modules", "dependencies", "request_flow", "debt"),
    "expert": ("overview", "architecture", "patterns", "components", "modules", "dependencies", "coupling_metrics", "request_flow", "c4", "debt", "recommendations"),
}
TITLES = {
    "overview": "Project Overview", "components": "Key Components", "getting_started": "Getting Started", "glossary": "Glossary", "architecture": "Architecture", "patterns": "Detected Patterns", "modules": "Modules",
    "dependencies": "Dependencies", "coupling_metrics": "Coupling Metrics", "request_flow": "Request Flow", "c4": "C4 Model", "debt": "Technical Debt", "recommendations": "Recommendations",
}
GLOSSARY = (
    ("Controller", "takes requests and gives answers"), ("Service", "holds business rules"), ("Repository", "reads and writes stored data"), ("Entity", "is stored data"),
    ("DTO", "carries data between parts"), ("Layer", "is a group of classes with one duty"),
)

#: Classes and packages that a section names.
NAMED = 15


def _keyed(rows: DataFrame) -> DataFrame:
    """(part, key, line) from lines ordered by a number."""
    key = F.lpad(F.col("k").cast("string"), 10, "0") if "key" not in rows.columns else F.concat(F.lpad(F.col("k").cast("string"), 10, "0"), F.lit("-"), "key") if "k" in rows.columns else F.col("key")
    return rows.select(F.col("part").cast("int").alias("part"), key.alias("key"), "line")


def sections(roles: DataFrame, nodes: DataFrame, edges: DataFrame, base: str, level: str) -> DataFrame:
    """(section, part, key, line) of the document for a level; a heading is the first line of each section."""
    return documents(roles, nodes, edges, base, (level,)).drop("level")


def documents(roles: DataFrame, nodes: DataFrame, edges: DataFrame, base: str, levels: tuple[str, ...] = tuple(SECTIONS)) -> DataFrame:
    """(level, section, part, key, line) of the documents for several levels; what levels share is made once."""
    from lithograph.operators import graph as G

    spark = roles.sparkSession
    said = S.summaries(roles, base)
    summary = lambda *names: said.where(F.col("name").isin(*names)).select(F.lit(1).alias("part"), F.col("name").alias("key"), F.col("text").alias("line"))
    metrics = G.degrees(nodes, edges.select("src", "dst"))
    total = F.col("ca") + F.col("ce")
    coupled = metrics.where(total > 0).orderBy(F.desc(total), "id").limit(NAMED)
    made = {
        "overview": lambda: summary("onboarding_intro", "layer_summary"),
        "architecture": lambda: S.layers(roles, nodes, edges).select(F.lit(1).alias("part"), F.lpad(F.col("place").cast("string"), 3, "0").alias("key"), F.format_string("| %s | %d | %d | %d |", "layer", "class_count", "inbound", "outbound").alias("line")),
        "patterns": lambda: S.pattern_lines(S.patterns(roles)).select(F.lit(1).alias("part"), F.col("k").cast("string").alias("key"), F.concat(F.lit("* "), "line").alias("line")),
        "components": lambda: S.role_lines(roles),
        "modules": lambda: S.modules(roles, base).select(F.lit(1).alias("part"), F.col("module").alias("key"), F.format_string("| %s | %d | %s |", "module", "members", "roles").alias("line")),
        "dependencies": lambda: coupled.select(F.lit(1).alias("part"), F.format_string("%010d-%s", F.lit(10**9) - total, "id").alias("key"), F.format_string("* %s: %d", "id", total).alias("line")),
        "coupling_metrics": lambda: coupled.select(F.lit(1).alias("part"), F.format_string("%010d-%s", F.lit(10**9) - total, "id").alias("key"), F.format_string("| %s | %d | %d | %.2f |", "id", "ca", "ce", "instability").alias("line")),
        "request_flow": lambda: _keyed(S.request_flow(roles)),
        "c4": lambda: _keyed(S.container_text(roles, base.split(".")[-1].title())),
        "getting_started": lambda: summary("quick_start"),
        "debt": lambda: metrics.where("highly_coupled").agg(F.count("*").alias("n")).select(F.lit(1).alias("part"), F.lit("0").alias("key"), F.format_string("%d highly coupled class(es)", "n").alias("line")),
        "recommendations": lambda: summary("critique"),
        "glossary": lambda: spark.createDataFrame([(1, f"{k:02d}", f"* {a}: {b}") for k, (a, b) in enumerate(GLOSSARY)], "part int, key string, line string"),
    }
    places = [(level, n, name) for level in levels for n, name in enumerate(SECTIONS[level], 1)]
    heads = spark.createDataFrame([(level, n, 0, "", f"## {n}. {TITLES[name]}") for level, n, name in places], "level string, section int, part int, key string, line string")
    names = sorted({name for _, _, name in places})
    bodies = S.union(*(made[name]().select(F.lit(name).alias("name"), (F.col("part") + 1).cast("int").alias("part"), "key", "line") for name in names))
    told = bodies.join(F.broadcast(spark.createDataFrame(places, "level string, section int, name string")), "name")  # a row for each section of each level
    return heads.unionByName(told.select("level", "section", "part", "key", "line"))


_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


_BODY = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>', "</w:body></w:document>")


def paragraph(line: Column) -> Column:
    """A line as a paragraph of a word-processor file; headings are bold."""
    bold = line.startswith("#")
    clean = F.regexp_replace(line, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")
    text = F.replace(F.replace(F.replace(F.when(bold, F.regexp_replace(clean, "^[# ]+", "")).otherwise(clean), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<w:p><w:r>"), F.when(bold, "<w:rPr><w:b/></w:rPr>").otherwise(""), F.lit('<w:t xml:space="preserve">'), text, F.lit("</w:t></w:r></w:p>"))


def save_packed(rows: DataFrame, path: str) -> int:
    """The document as one file of any length; returns its lines.

    Paragraphs are made and ordered by Spark and come to the driver a part at a time, which
    it deflates into the store's stream: it holds a part and no document.
    """
    spark = rows.sparkSession
    order = ("section", "part", "key")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(paragraph(F.col("line")).alias("text"))
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    n = 0
    try:
        with zipfile.ZipFile(_Out(stream), "w", zipfile.ZIP_DEFLATED) as file:
            for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS)):
                file.writestr(name, part)
            with file.open("word/document.xml", "w", force_zip64=True) as body:
                body.write(_BODY[0].encode())
                for row in ordered.toLocalIterator():
                    body.write(row.text.encode())
                    n += 1
                body.write(_BODY[1].encode())
    finally:
        stream.close()
    return n


class _Out(io.RawIOBase):
    """A file to write to, over a stream of the store; what is written goes on in pieces of 64 KB."""

    def __init__(self, stream):
        self.stream, self.held = stream, bytearray()

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.held += data
        if len(self.held) >= 1 << 16:
            self.flush()
        return len(data)

    def flush(self) -> None:
        if self.held:
            self.stream.write(bytearray(self.held))
            self.held.clear()
