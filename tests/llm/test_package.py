"""What the package promises as a whole."""

import ast
import re

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tutorspark.llm import storage
from tutorspark.llm.queries import llm_queries


def test_each_operator_has_one_query():
    names = [n for n in entry_points.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) == set(llm_queries()) and "pipeline" in entry_points.queries()
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_nothing_else_imports_it():
    for path in (ROOT / "tutorspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path


def test_forbidden_calls():
    files = [*(ROOT / "tutorspark" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"]
    for path in files:
        tree = ast.parse(path.read_text())
        called = {n.func.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute)}
        assert not called & {"localCheckpoint", "crossJoin", "toPandas", "sample", "broadcast", "persist", "cache"}, path
        assert not any(isinstance(n, ast.Attribute) and n.attr == "rdd" for n in ast.walk(tree)), path


def test_only_bounded_rows_come_to_the_driver():
    """The two samples and the languages' counts, of which the docstrings state the bounds."""
    found = {}
    for path in (ROOT / "tutorspark" / "llm").glob("*.py"):
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute) and node.attr in ("collect", "toLocalIterator", "take"):
                found[path.stem] = found.get(path.stem, 0) + (node.attr == "collect")
    assert {k: n for k, n in found.items() if n} == {"cover_tree": 1, "language_crf": 2}


def test_kept_tables(spark):
    df = spark.range(5).withColumn("node", F.monotonically_increasing_id())
    kept = storage.keep(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and kept.count() == 5
    assert storage.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert "FileScan" in kept._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_every_query_runs_on_the_smallest_tables(spark, name):
    df = llm_queries()[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0 and df.schema == llm_queries()[name](spark, "/root/testdata/sf0.001").schema
