"""The tabs end to end, with full and with very little data."""

import pytest
from conftest import SMOKE_DIR, one

from tutorspark.plans.analysis import Analysis
from tutorspark.workload import views


@pytest.fixture(scope="module")
def smoke(spark):
    return views.sessions(spark, SMOKE_DIR), views.roster(spark, SMOKE_DIR)


def test_every_table_of_every_tab(spark, smoke):
    analysis = Analysis.of(*smoke, filters={"gender": ["Female", "Male", "Nonbinary"], "ell": "No"}, total_cost=1000.0)
    try:
        for tab in ("overview", "dosage", "equity", "outcomes", "cost", "cohort"):
            tables = getattr(analysis, tab)()
            assert len(tables) > 1
            for name in tables:
                assert tables[name].columns, (tab, name)
                tables[name].write.format("noop").mode("overwrite").save()
        population = one(analysis.dosage()["population"])
        assert population["matched_students"] == analysis.prepared.filter("ell = false").count()
    finally:
        analysis.prepared.unpersist()


def test_filters_leave_time_views_and_the_cost_base_alone(smoke):
    narrow = Analysis.of(*smoke, keep=False, filters={"school_name": "no such school"}, total_cost=10.0)
    assert one(narrow.dosage()["population"])["matched_students"] == 0
    assert narrow.dosage()["hourly"].count() == 24
    assert one(narrow.cost()["metrics"])["allocated_cost"] is None
    everyone = Analysis.of(*smoke, keep=False, total_cost=10.0)
    assert one(everyone.cost()["metrics"])["cost_allocation_share"] == pytest.approx(1.0)


def test_a_bare_roster_still_has_its_tables(table):
    analysis = Analysis.of(table([("1", 90.0)], "student_id string, session_duration double"), table([("1",), ("2",)], "student_id string"), keep=False)
    assert set(analysis.dosage()) == {"population", "metrics", "histogram"}
    assert one(analysis.dosage()["metrics"])["mean_hours"] == 1.5
    for tab in ("overview", "dosage", "equity", "outcomes", "cost", "cohort"):
        tables = getattr(analysis, tab)()
        for name in tables:
            tables[name].collect()


def test_prepared_table_in_a_folder(smoke, tmp_path):
    analysis = Analysis.of(*smoke, path=str(tmp_path / "prepared"))
    assert analysis.prepared.inputFiles()
    assert analysis.prepared.count() == smoke[1].count()
