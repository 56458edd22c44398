"""Every registered query against its SQL, and the shape of the plans."""

import ast
from pathlib import Path

import pytest
from compare import differences, sql_connection
from conftest import ROOT, SMOKE_DIR

import __spark_entry__ as entry_points
from tutorspark.workload.oracles import all_oracles
from tutorspark.workload.queries import all_queries

QUERIES = all_queries()
SQL = all_oracles()


@pytest.fixture(scope="module")
def con():
    return sql_connection(SMOKE_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SMOKE_DIR), con, SQL[name]) is None


def test_the_entry_lists_them():
    assert QUERIES.keys() <= entry_points.queries().keys()
    assert SQL.keys() <= entry_points.oracle_sql().keys()


def test_entry(spark):
    assert entry_points.entry(spark).count() == 25


def test_no_row_goes_through_python_but_for_p_values(spark, plan_of):
    for name in ("A7_school_dosage", "A20_score_participation", "V7_session_issues", "A44_weighted_sample", "P4_typed_roster"):
        plan = plan_of(QUERIES[name](spark, SMOKE_DIR))
        assert "Python" not in plan and "Pandas" not in plan, name
    assert "ArrowEvalPython" in plan_of(QUERIES["A15_p_values"](spark, SMOKE_DIR))


def test_scans_read_only_what_they_need(spark, plan_of):
    plan = plan_of(QUERIES["A1_hours_per_student"](spark, SMOKE_DIR))
    assert "ReadSchema: struct<user_id:bigint,value:double>" in plan


def test_no_cross_joins_or_collects_in_the_library():
    for path in Path(ROOT / "tutorspark").rglob("*.py"):
        if "llm" in path.parts:
            continue  # optional, with tests of its own
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Attribute):
                assert node.attr not in {"crossJoin", "collect", "toPandas", "localCheckpoint", "rdd"}, path
