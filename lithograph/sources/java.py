"""Java sources as tables: scanning a tree, file metadata, types, and dependency edges.

Files are read once, as one table, and scanned once, by a function over Arrow batches that
matches braces (``java_types``); everything else is columns over what it returns.
"""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs as stores
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithograph.functions.storage import saved
from lithograph.functions.values import per_value
from lithograph.sources.java_types import FILE_SCHEMA, read

# Which files are scanned, and directories that are not.
EXTENSIONS = (".java", ".xml", ".properties", ".yaml", ".yml", ".md")
EXCLUDED = ("target", "build", ".git", ".gradle", ".mvn", "node_modules", ".idea", ".vscode", "__pycache__", "generated-sources", "generated-test-sources", "test-classes", "classes")
# Words after @ in documentation comments, which are no annotations.
JAVADOC_WORDS = ("param", "return", "returns", "throws", "exception", "see", "since", "author", "version", "deprecated", "link")
# Packages of libraries, to which no dependency is recorded.
LIBRARIES = (
    "java.", "javax.", "jakarta.", "sun.", "com.sun.", "org.springframework.", "org.junit.", "org.slf4j.", "org.apache.", "com.fasterxml.",
    "io.micrometer.", "org.hibernate.", "org.aspectj.", "reactor.", "kotlin.", "scala.", "groovy.",
)
INJECTION = ("Autowired", "Inject", "Resource", "Value", "Qualifier")
# Component types by annotation, and the colours of nodes.
COMPONENT_TYPES = {
    "Service": "service", "RestController": "controller", "Controller": "controller", "RequestMapping": "controller", "Repository": "repository", "Component": "component",
    "Configuration": "configuration", "Bean": "bean", "Singleton": "service", "Named": "component",
}
NODE_COLORS = {
    "controller": "#FF6B6B", "service": "#4ECDC4", "repository": "#45B7D1", "component": "#96CEB4", "configuration": "#FFEAA7", "bean": "#FFEAA7", "unknown": "#DFE6E9",
}
EDGE_PRIORITY = {"constructor_injection": 3, "field_injection": 2, "import": 1}


def walk(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED, threads: int = 32) -> tuple[list[str], list[str]]:
    """All directories of a tree, itself first, and its files without a byte; excluded directories are never opened.

    Each directory is listed once, through Hadoop's file system, many at a time.  The driver holds
    their names, as it does for any table of files.
    """
    jvm = spark.sparkContext._jvm
    start = jvm.org.apache.hadoop.fs.Path(root)
    system = start.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def below(name: str) -> tuple[list[str], list[str]]:
        inside, empty = [], []
        for status in system.listStatus(jvm.org.apache.hadoop.fs.Path(name)):
            path = status.getPath()
            if status.isDirectory():
                inside += [path.toString()] if path.getName() not in excluded else []
            elif status.getLen() == 0:
                empty.append(path.toString())
        return inside, empty

    found = level = [system.makeQualified(start).toString()]
    blank: list[str] = []
    with ThreadPoolExecutor(threads) as pool:
        while level:
            held = list(pool.map(below, level))
            level = [d for inside, _ in held for d in inside]
            blank += [f for _, empty in held for f in empty]
            found = found + level
    return found, blank


def _literal(path: str) -> str:
    """A path that stands for itself where a pattern could stand."""
    return re.sub(r"([\\{}\[\]*?,])", r"\\\1", path)


#: Up to so many files are planned by the driver; of more it holds no names, and tasks list and read them.
PLANNED_FILES = 20_000
#: Files that a task lists to read, and files and bytes that it hands on at once.
TASK_FILES, READ_FILES, READ_BYTES = 2048, 256, 1 << 24


def scan(spark: SparkSession, root: str, planned: int = PLANNED_FILES) -> DataFrame:
    """(file_path relative to root, content) of files with a known extension outside excluded directories.

    Neither excluded directories nor other files are opened.  Directories are listed by tasks,
    level by level, and the driver holds names of directories alone.  The files of a small tree, or of a store
    that Arrow does not reach, are planned as a table of files; those of a large one are dealt to tasks, which read them.
    """
    try:
        _store(root)
    except (pa.ArrowException, OSError, ValueError):
        return _planned(spark, root)
    files = _listed(spark, root)
    number = files.count()
    if number <= planned:
        return _planned(spark, root)

    def contents(batches):
        store, base = _store(root)
        for batch in batches:
            held, size = [], 0
            for name in batch["file_path"].to_pylist():
                with store.open_input_file(f"{base}/{name}") as source:
                    held.append((name, source.read()))
                size += len(held[-1][1])
                if len(held) == READ_FILES or size >= READ_BYTES:
                    yield _contents(held)
                    held, size = [], 0
            yield _contents(held)

    return files.select("file_path").repartition(max(spark.sparkContext.defaultParallelism, -(-number // TASK_FILES)), "file_path").mapInArrow(contents, "file_path string, content binary")


def _contents(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.record_batch({"file_path": pa.array([n for n, _ in rows], pa.string()), "content": pa.array([c for _, c in rows], pa.binary())})


def _store(root: str):
    """A store that Arrow reaches, and the path of ``root`` in it."""
    if ":" in root.partition("/")[0] and not root.startswith("file:"):
        return stores.FileSystem.from_uri(root)
    return stores.LocalFileSystem(), re.sub("^file:/*", "/", root).rstrip("/")


def _listed(spark: SparkSession, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(file_path, size) of the files that a scan reads, saved; each directory is listed by a task."""

    def below(batches):
        store, base = _store(root)
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                found = store.get_file_info(stores.FileSelector(f"{base}/{folder}".rstrip("/")))
                folders = [f.type == stores.FileType.Directory for f in found]
                # A folder's files are handed on at once: a name and a size for each.
                yield pa.record_batch({
                    "file_path": pa.array([f"{folder}/{f.base_name}".lstrip("/") for f in found], pa.string()), "size": pa.array([f.size or 0 for f in found], pa.int64()), "is_folder": pa.array(folders, pa.bool_()),
                })

    name = F.substring_index("file_path", "/", -1)
    # As Spark's readers do, files whose name begins as a hidden one's are left out, but for empty ones.
    shown = (F.col("size") == 0) | ~(name.startswith(".") | (name.startswith("_") & ~name.contains("=")))
    level, files = [""], None
    while level:
        folders = spark.createDataFrame([(f,) for f in level], "folder string").repartition(min(len(level), 4096), "folder")
        found = saved(folders.mapInArrow(below, "file_path string, size long, is_folder boolean"))
        level = [r[0] for r in found.where(F.col("is_folder") & ~name.isin(*excluded)).select("file_path").collect()]
        known = found.where(~F.col("is_folder") & F.lower("file_path").rlike("(" + "|".join(re.escape(x) for x in EXTENSIONS) + ")$") & shown).select("file_path", "size")
        files = known if files is None else files.unionByName(known)
    return files


def _planned(spark: SparkSession, root: str) -> DataFrame:
    """The directories that are kept are a scan's paths and the extensions its file pattern, so Spark deals the files that are read."""
    kept, blank = walk(spark, root)
    any_case = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in EXTENSIONS)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{{{any_case}}}").load([_literal(d) for d in kept])
    # Spark lists no file without a byte.
    known = [(f, bytearray()) for f in blank if f.lower().endswith(EXTENSIONS)]
    both = files.select("path", "content").unionByName(spark.createDataFrame(known, "path string, content binary"))
    return both.select(F.expr(f"substr(path, {len(kept[0]) + 2})").alias("file_path"), "content")


def write_tree(files: DataFrame, root: str) -> int:
    """Write each file below ``root``, in any store that Arrow's file systems reach; how many there were."""

    def write(batches):
        (store, base), made = _store(root), set()
        for batch in batches:
            for name, raw in zip(batch["file_path"].to_pylist(), batch["content"].to_pylist()):
                target = f"{base}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write(raw or b"")
            yield pa.record_batch({"n": pa.array([len(batch)], pa.int64())})

    return files.select("file_path", "content").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def supported(rows: DataFrame) -> DataFrame:
    """Rows whose ``file_path`` has a known extension and no excluded part."""
    suffix = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1))
    inside = F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, EXCLUDED)))
    return rows.where(suffix.isin(*EXTENSIONS) & ~inside)


def with_content(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with the content of their files, read once; empty, and not ``readable``, where there is none."""
    found = texts.select("file_path", "content", F.lit(True).alias("readable"))
    out = rows.join(found, "file_path", "left")
    return out.withColumns({"content": F.coalesce("content", F.lit("").cast("binary")), "readable": F.coalesce("readable", F.lit(False))})


def parse(files: DataFrame) -> DataFrame:
    """One metadata row per Java file: package, imports, annotations, types, methods, size and hash; ``error`` where one cannot be read.

    ``classes``, ``interfaces`` and ``enums`` hold nested types too; ``methods`` the methods and
    constructors of all types; each name once, in order.
    """

    scanned = per_value(read, FILE_SCHEMA)
    java = files.where(F.col("file_path").endswith(".java"))
    rows = java.withColumn("f", scanned("content"))
    named = lambda kind: F.array_distinct(F.transform(F.filter("f.types", lambda t: t["kind"] == kind), lambda t: t["name"]))
    callable_ = F.flatten(F.transform("f.types", lambda t: F.transform(F.filter(t["members"], lambda m: m["kind"] != "field"), lambda m: m["name"])))
    text = F.col("content").cast("string")
    return rows.select(
        "file_path", F.col("f.package").alias("package"), F.transform("f.imports", lambda i: i["name"]).alias("imports"), F.array_except("f.annotations", F.array(*map(F.lit, JAVADOC_WORDS))).alias("annotations"),
        named("class").alias("classes"), named("interface").alias("interfaces"), named("enum").alias("enums"), F.array_distinct(callable_).alias("methods"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("lines_of_code"), F.md5("content").alias("content_hash"),
        F.col("f.imports").alias("import_lines"), F.col("f.types").alias("types"), text.alias("source"), F.col("f.error").alias("error"),
    )


def types(parsed: DataFrame) -> DataFrame:
    """One row per type, nested ones too (``depth`` 0: top level): file_path, package, place in the file and what ``read`` tells."""
    rows = parsed.select("file_path", "package", "imports", "import_lines", F.posexplode("types").alias("seq", "t"))
    return rows.select("file_path", "package", "imports", "import_lines", "seq", "t.*")


def class_type(annotations: Column) -> Column:
    """The component type of the first annotation that has one; else unknown."""
    known = F.create_map(*(F.lit(x) for kv in COMPONENT_TYPES.items() for x in kv))
    return F.coalesce(F.get(F.filter(F.transform(annotations, lambda a: known[a]), lambda t: t.isNotNull()), F.lit(0)), F.lit("unknown"))


def edges(parsed: DataFrame) -> DataFrame:
    """(src, dst, dep_type, source_file, line, seq): imports, injected fields and constructor parameters of each top-level type.

    An import counts if its last segment is capitalised and it is no library's.  Of several edges
    between two types of a file the strongest stays, then the first.
    """
    top = types(parsed).where("depth = 0")
    library = F.lit("^(" + "|".join(re.escape(p) for p in LIBRARIES) + ")")
    taken = F.transform(F.filter("import_lines", lambda i: ~F.regexp_like(i["name"], library)), lambda i: F.struct(F.element_at(F.split(i["name"], r"\."), -1).alias("dst"), F.lit("import").alias("dep_type"), i["line"].alias("line")))

    def members(kind: str, dep_type: str, *, injected: bool):
        own = F.filter("members", lambda m: (m["kind"] == kind) & (F.arrays_overlap(m["annotations"], F.array(*map(F.lit, INJECTION))) if injected else F.lit(True)))
        return F.flatten(F.transform(own, lambda m: F.transform(m["targets"], lambda d: F.struct(d.alias("dst"), F.lit(dep_type).alias("dep_type"), m["line"].alias("line")))))

    # Members of an enumeration are no dependencies of it.
    own = F.concat(members("field", "field_injection", injected=True), members("constructor", "constructor_injection", injected=False))
    rows = top.select(F.col("name").alias("src"), F.col("file_path").alias("source_file"), F.posexplode(F.concat(taken, F.when(F.col("kind") == "enum", F.slice(own, 1, 0)).otherwise(own))).alias("seq", "e"))
    rows = rows.select("src", "source_file", "seq", "e.*").where(F.col("dst").rlike(r"^\p{Lu}") & (F.col("dst") != F.col("src")))
    rank = F.create_map(*(F.lit(x) for kv in EDGE_PRIORITY.items() for x in kv))
    best = F.min_by(F.struct("dep_type", "line", "seq"), F.struct(-rank[F.col("dep_type")], "seq"))
    return rows.groupBy("src", "dst", "source_file").agg(best.alias("b")).select("src", "dst", "b.dep_type", "source_file", "b.line", "b.seq")


def nodes(parsed: DataFrame) -> DataFrame:
    """One row per name of a top-level type: id, package, class_type, annotations, file_path, color.

    Of several types of one name the last file in path order tells its attributes.
    """
    rows = types(parsed).where("depth = 0").select(F.col("name").alias("id"), F.coalesce("package", F.lit("")).alias("package"), class_type(F.col("annotations")).alias("class_type"), "annotations", "file_path", "seq")
    last = rows.groupBy("id").agg(F.max_by(F.struct("package", "class_type", "annotations", "file_path"), F.struct("file_path", "seq")).alias("n")).select("id", "n.*")
    colors = F.create_map(*(F.lit(x) for kv in NODE_COLORS.items() for x in kv))
    return last.withColumn("color", F.coalesce(colors[F.col("class_type")], F.lit(NODE_COLORS["unknown"])))


def graph(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes, and the internal edges among them: the strongest kind with its line, the file of the first."""
    known = nodes(parsed)
    raw = edges(parsed)
    inner = raw.join(known.select(F.col("id").alias("dst")), "dst", "left_semi").where("src <> dst")
    rank = F.create_map(*(F.lit(x) for kv in EDGE_PRIORITY.items() for x in kv))
    order = F.struct("source_file", "seq")
    merged = inner.groupBy("src", "dst").agg(F.min_by(F.struct("dep_type", "line"), F.struct(-rank[F.col("dep_type")], order)).alias("b"), F.min_by("source_file", order).alias("source_file"))
    return known, merged.select("src", "dst", "b.dep_type", "source_file", "b.line")


def incremental(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files whose (path, hash) the index lacks."""
    return files.join(indexed.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")
