"""Registered queries: shapes, names, and the engine without the optional subpackage."""

import os
import pathlib
import subprocess
import sys

import pytest

DATA = pathlib.Path("/root/testdata/sf0.001")
ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 70


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25


def test_rest_works_without_llm(tmp_path):
    for item in ("lithograph", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / item), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lithograph" / "llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'graph_edges' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})


def test_nothing_else_imports_llm():
    for path in (ROOT / "lithograph").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "lithograph.llm" not in path.read_text()


WORKER = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
seen = spark.sparkContext.parallelize([0], 1).map(lambda _: __import__("importlib").util.find_spec("lithograph") is not None).collect()
assert seen == [False], "the worker's own path has the library"
from lithograph import catalog
assert catalog.queries()["java_types"](spark, {data!r}).count() > 0
"""


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_executors_need_no_library_on_their_path(tmp_path):
    env = {"PATH": os.environ["PATH"], "HOME": str(tmp_path)} | {k: v for k, v in os.environ.items() if k.startswith(("JAVA", "SPARK"))}
    subprocess.run([sys.executable, "-c", WORKER.format(root=str(ROOT), data=str(DATA))], cwd=tmp_path, check=True, env=env, timeout=300)
