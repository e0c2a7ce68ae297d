"""Keyed tables, incremental ingest, scanning of trees, job states."""

import pytest
from pyspark.sql import functions as F

from lithograph.functions import files as fs
from lithograph.sources.keyed import KeyedTable
from lithograph.streaming.events import work_folder
from lithograph.streaming.ingest import ChunkIndex, ingest


def frame(spark, rows, schema="owner string, part int, v string"):
    return spark.createDataFrame(rows, schema)


def keyed(spark, buckets=8, **how):
    return KeyedTable(spark, work_folder(spark, "keyed"), frame(spark, []).schema, ("owner",), buckets, **how)


def content(table):
    return sorted(((r.owner is not None, r.owner or "", r.part, r.v) for r in table.read().collect()))


def parts(table):
    return {b: fs.names(table.spark, folder) for b, folder in table._held().items()}


def test_merge_rewrites_only_what_a_batch_touches(spark):
    table = keyed(spark)
    first = [(f"f{k}", p, "old") for k in range(40) for p in range(3)] + [(None, 0, "null owner")]
    table.replace(frame(spark, first), frame(spark, first))
    before = parts(table)
    assert len(content(table)) == 121 and len(before) == 8
    changed = [("f3", 0, "new"), ("f3", 1, "new")]
    touched = table.replace(frame(spark, changed), frame(spark, changed))
    after = parts(table)
    assert len(touched) == 1 and all(before[b] == after[b] for b in before if b not in touched) and before[touched[0]] != after[touched[0]]
    assert [x[2:] for x in content(table) if x[1] == "f3"] == [(0, "new"), (1, "new")]
    gone = table.replace(frame(spark, []), frame(spark, [("f5", 0, ""), ("f3", 0, ""), (None, 0, "")]))
    assert len(content(table)) == 121 - 3 - 3 - 1 and len(gone) <= 3
    assert {x[1] for x in content(table)} == {f"f{k}" for k in range(40)} - {"f3", "f5"}
    assert sorted(r.part for r in table.lookup(frame(spark, [("f7", 9, "")])).collect()) == [0, 1, 2]
    # Older snapshots are there until they are swept.
    assert table.read(table.snapshots()[0]).count() == 121
    table.vacuum(1)
    assert len(table.snapshots()) == 1 and len(content(table)) == 114


def test_merge_is_done_once_and_upsert_keeps_the_last(spark):
    table = keyed(spark, 3, files=2)
    table.upsert(frame(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")]), ["part"], 0)
    assert table.upsert(frame(spark, [("a", 9, "again")]), ["part"], 0) == []
    table.upsert(frame(spark, [("a", 1, "late"), ("b", 6, "next"), ("c", 0, "new")]), ["part"], 1)
    assert content(table) == [(True, "a", 2, "y"), (True, "b", 6, "next"), (True, "c", 0, "new")]
    assert table.upsert(frame(spark, []), ["part"], 2) == [] and table.snapshots() == [0, 1, 2]
    # A merge that died has left files and no snapshot.
    frame(spark, [("dead", 0, "")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{table.folder}/batches/3")
    table.upsert(frame(spark, [("d", 0, "v")]), ["part"], 3)
    assert [x[1] for x in content(table)] == ["a", "b", "c", "d"]
    assert not fs.publish_json(spark, f"{table.folder}/snapshots/3.json", {})
    with pytest.raises(ValueError):
        KeyedTable(spark, table.folder, table.schema, ("owner",), 4).read()


def source(name, body=""):
    return bytearray(f"package p;\nclass {name} {{ void go() {{ {body} }} }}\n".encode())


DROP = "file_path string, content binary, version long, dropped timestamp"


def test_ingest(spark):
    drops, folder = work_folder(spark, "drops"), work_folder(spark, "ingest")
    stamp = lambda rows: spark.createDataFrame(rows, "file_path string, content binary, version long").withColumn("dropped", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    stamp([(f"src/C{k}.java", source(f"C{k}"), 1) for k in range(12)] + [("src/notes.txt", bytearray(b"x"), 1), ("target/Z.java", source("Z"), 1)]).coalesce(1).write.parquet(f"{drops}/1")
    index = ingest(spark, drops, folder, per_batch=1, buckets=16)
    names = lambda: {r.class_name for r in index.chunks.read().collect()}
    assert names() == {f"C{k}" for k in range(12)}
    before = parts(index.chunks)
    # A change, a repeat of what is there under a later version, a deletion, a late version.
    stamp([("src/C1.java", source("D1"), 2), ("src/C2.java", source("C2"), 2), ("src/C3.java", None, 2), ("src/C4.java", source("Old4"), 0)]).coalesce(1).write.parquet(f"{drops}/2")
    index = ingest(spark, drops, folder, per_batch=1, buckets=16)
    assert names() == {f"C{k}" for k in range(12)} - {"C1", "C3"} | {"D1"}
    touched = {b for b in before if parts(index.chunks).get(b) != before[b]}
    assert 1 <= len(touched) <= 2
    # The same folder again, and the same files in a stream of their own: nothing is written.
    held = index.chunks.snapshots(), index.files.snapshots()
    ingest(spark, drops, folder, per_batch=1, buckets=16)
    assert (index.chunks.snapshots(), index.files.snapshots()) == held
    other = ChunkIndex(spark, f"{folder}/index", 16)
    assert other.take(spark.read.schema(DROP).parquet(f"{drops}/1")) == ([], []) and other.take(spark.read.schema(DROP).parquet(f"{drops}/2")) == ([], [])
    # A late version of a file that is gone stays out.
    assert other.take(stamp([("src/C3.java", source("C3"), 1)])) == ([], [])


def test_scan_opens_no_excluded_directory(spark, tmp_path):
    from lithograph.sources import java

    root = tmp_path / "a+b (x) [y], {z} %20"
    files = {
        "A.java": b"a", "src/p q/B.JAVA": b"bb", "src/p/C.yml": b"ccc", "src/p/README.md": b"", "src/p/pom.Xml": b"d", "src/p/target.properties": b"e", "src/empty/x.txt": b"no", "no_suffix": b"no", "src/x.javac": b"no",
        ".git/objects/big.java": b"x" * 10_000, "src/target/classes/D.java": b"no", "module/build/E.java": b"no", "node_modules/deep/er/F.java": b"no", "classes/G.md": b"no",
    }
    for name, raw in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    kept = {"A.java", "src/p q/B.JAVA", "src/p/C.yml", "src/p/README.md", "src/p/pom.Xml", "src/p/target.properties"}
    found = java.scan(spark, str(root))
    assert {r.file_path: bytes(r.content) for r in found.collect()} == {n: files[n] for n in kept}
    # What the scan plans to open, and its bytes, are those files alone.
    opened = found.inputFiles()
    assert len(opened) == len(kept) and not any("objects" in f or "deep" in f for f in opened)
    assert found.agg(F.sum(F.length("content"))).first()[0] == sum(len(files[n]) for n in kept)
    assert not any(d.endswith(("/.git", "/target", "/objects", "/deep", "/classes", "/build")) for d in java.walk(spark, str(root))[0])
    (tmp_path / "nothing").mkdir()
    assert java.scan(spark, str(tmp_path / "nothing")).count() == 0
    copy = work_folder(spark, "copy")
    assert java.write_tree(found, copy) == len(kept) and java.scan(spark, copy).count() == len(kept)


def test_job_machine_refuses_times_out_and_goes_on_after_a_restart(spark):
    from lithograph.streaming import events as S

    folder, source = work_folder(spark, "jobs"), work_folder(spark, "events")
    schema = "user_id long, event_type string, ts timestamp, event_id long"

    def run(rows):
        spark.createDataFrame(rows, "user_id long, event_type string, t string, event_id long").selectExpr("user_id", "event_type", "CAST(t AS TIMESTAMP) AS ts", "event_id").coalesce(1).write.mode("append").parquet(source)
        return {r.user_id: tuple(r)[1:] for r in S.jobs(spark.readStream.schema(schema).parquet(source), folder, "1 hour", "10 minutes").collect()}

    day = "2026-01-01 "
    first = run([
        (1, "signup", day + "10:00:00", 1), (1, "click", day + "10:01:00", 2), (1, "purchase", day + "10:02:00", 3), (1, "click", day + "10:03:00", 4),
        (2, "click", day + "10:00:00", 5), (2, "signup", day + "10:00:01", 6), (2, "purchase", day + "10:00:02", 7), (3, "signup", day + "10:30:00", 8), (4, "signup", day + "12:00:00", 9), (4, "view", day + "12:00:00", 10),
    ])
    # steps, refused, late, stuck: user 2 may not run before it is pending nor complete before it runs; 2 and 3 have waited too long.
    assert first == {1: ("completed", 3, 1, 0, 0), 2: ("failed", 1, 2, 0, 1), 3: ("failed", 1, 0, 0, 1), 4: ("running", 2, 0, 0, 0)}
    second = run([(4, "purchase", day + "11:59:00", 11), (4, "click", day + "12:30:00", 12), (1, "signup", day + "12:10:00", 13), (1, "error", day + "12:20:00", 14), (5, "view", day + "13:15:00", 15)])
    assert second[4] == ("running", 3, 0, 1, 0) and second[1] == ("failed", 5, 1, 0, 0) and second[5] == ("none", 0, 1, 0, 0)
    third = run([(5, "signup", day + "18:00:00", 16)])
    assert third[4] == ("failed", 3, 0, 1, 1) and third[5] == ("pending", 1, 1, 0, 0)


def test_files_of_a_large_tree_are_listed_and_read_by_tasks(spark, tmp_path):
    """The driver plans no file of a large tree; the result is the same."""
    from lithograph.sources import java

    root = tmp_path / "big [a]"
    for name, raw in {"A.java": b"a", "src/p q/B.JAVA": b"bb", "src/p/README.md": b"", "src/_hidden.java": b"no", "src/target/D.java": b"no", "x.txt": b"no", "src/deep/er/E.yml": b"e" * 1000}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(raw)
    found = java.scan(spark, str(root), planned=2)
    assert found.inputFiles() == [] or not any(f.lower().endswith((".java", ".yml", ".md")) for f in found.inputFiles())
    told = {r.file_path: bytes(r.content) for r in found.collect()}
    assert told == {r.file_path: bytes(r.content) for r in java.scan(spark, str(root)).collect()} and len(told) == 4
