"""J1-J7, A1-A3, P11-P15."""

import math
import os

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from tutorspark.functions import bands
from tutorspark.operators import joins
from tutorspark.operators.dosage import dosage_metrics
from tutorspark.operators.prepare import (
    hours_by_subject,
    hours_per_student,
    hours_per_student_topic,
    prepare,
    roster_with_subject_hours,
    with_outcome_columns,
)

SESSIONS = "student_id string, session_topic string, session_date string, session_duration double, tutor_id string"


@pytest.fixture(scope="module")
def sessions(table):
    return table(
        [
            ("001", "math", "2026-01-15", 30.0, "T1"),
            (" 001", "ela", "2026-01-16", 45.0, "T1"),
            ("002", "math", "2026-01-17", 60.0, "T2"),
            ("002", "science", "2026-01-17", -6.0, "T2"),
            ("999", "math", "2026-01-17", 600.0, "T2"),
            (None, "math", "2026-01-17", 600.0, "T2"),
            ("004", None, None, None, None),
        ],
        SESSIONS,
    )


def test_hours_are_rolled_up_and_joined(table, sessions):
    roster = table([("001 ",), ("002",), ("003",), (None,), ("001",), ("004",)], "student_id string")
    got = sorted((r.student_id or "", r.total_hours, r.received_tutoring) for r in prepare(sessions, roster).collect())
    assert got == [
        ("", 0.0, False), ("001", 1.25, True), ("001", 1.25, True), ("002", 0.9, True), ("003", 0.0, False),
        ("004", 0.0, False),
    ]


def test_roll_up_tables(sessions):
    assert dict(rows(hours_per_student(sessions))) == {"001": 1.25, "002": 0.9, "004": 0.0, "999": 10.0}
    by_topic = {(r[0], r[1]): r[2] for r in rows(hours_per_student_topic(sessions))}
    assert by_topic == {("001", "math"): 0.5, ("001", "ela"): 0.75, ("002", "math"): 1.0, ("002", "science"): -0.1, ("999", "math"): 10.0}
    pivot = {r.student_id: (r.ela, r.math) for r in hours_by_subject(sessions).collect()}
    assert pivot == {"001": (0.75, 0.5), "002": (0.0, 1.0), "999": (0.0, 10.0)}


def test_missing_columns(table, sessions):
    no_id = table([("A",)], "school_name string")
    assert prepare(sessions, no_id).columns == ["school_name"]
    roster = table([("001",)], "student_id string")
    assert one(prepare(sessions.drop("session_duration"), roster))["total_hours"] == 0.0
    assert one(prepare(sessions.drop("student_id"), roster))["received_tutoring"] is False


def test_unknown_flag_stays_unknown_and_text_minutes_count(table):
    s = table([("001", "60"), ("001", "x"), ("001", "nan")], "student_id string, session_duration string")
    r = table([("001", None)], "student_id string, ell boolean")
    got = one(prepare(s, r))
    assert got["ell"] is None and got["total_hours"] == 1.0 and got["received_tutoring"] is True


def test_outcome_columns(table):
    df = table(
        [(700.0, 710.0, 725.0, 690.0, None), (700.0, 710.0, None, None, None)],
        "ela_outcome_measure_1 double, ela_outcome_measure_2 double, ela_outcome_measure_3 double, "
        "math_outcome_measure_1 double, math_outcome_measure_3 double",
    )
    first, second = (r.asDict() for r in with_outcome_columns(df).collect())
    assert (first["ela_latest_outcome"], first["ela_raw_gain"], first["ela_value_added"]) == (725.0, 25.0, 5.0)
    assert (second["ela_latest_outcome"], second["ela_raw_gain"], second["ela_value_added"]) == (710.0, None, None)
    # One measure missing from the table: latest from what there is, no gain.
    assert (first["math_latest_outcome"], first["math_raw_gain"]) == (690.0, None)


def test_subject_hours_join(table, sessions):
    roster = table([("001",), ("003",)], "student_id string")
    got = roster_with_subject_hours(prepare(sessions, roster), sessions)
    assert sorted((r.student_id, r.ela, r.math) for r in got.collect()) == [("001", 0.75, 0.5), ("003", 0.0, 0.0)]


def test_roster_keeps_its_column_order(table, sessions):
    roster = table([("A", "001")], "school_name string, student_id string")
    assert prepare(sessions, roster).columns[:4] == ["school_name", "student_id", "total_hours", "received_tutoring"]


def test_semi_join_split_and_grades(table, sessions):
    roster = table([("001", 3), ("001", 5), (None, 1), ("002", None)], "student_id string, current_grade_level int")
    trimmed = sessions.withColumn("student_id", F.trim("student_id"))
    assert joins.sessions_on_roster(trimmed, roster).count() == 4
    assert joins.sessions_on_roster(trimmed, roster).columns == sessions.columns
    members, rest = joins.split_by_ids(roster, trimmed)
    assert (members.count(), rest.count()) == (3, 1)
    graded = joins.sessions_with_grade(trimmed, roster)
    assert graded.count() == sessions.count()
    assert {r.student_id: r.current_grade_level for r in graded.collect()}["001"] == 5


def test_received_flag_forms(table):
    text = table([("Yes",), (" TRUE",), ("0",), (None,)], "received_tutoring string")
    assert [r[0] for r in rows(text.select(bands.received_tutoring(text)))] == [True, True, False, False]
    flag = table([(True,), (None,)], "received_tutoring boolean")
    assert [r[0] for r in rows(flag.select(bands.received_tutoring(flag)))] == [True, False]
    hours = table([(0.5,), (None,)], "total_hours double")
    assert [r[0] for r in rows(hours.select(bands.received_tutoring(hours)))] == [True, False]


def test_a_hot_id_is_split_between_tasks(spark, plan_of):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20kb",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50kb",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        n = 120_000
        roster = spark.range(0, n, 1, 16).selectExpr(
            "CASE id % 3 WHEN 0 THEN 'hot' WHEN 1 THEN NULL ELSE concat('s', id) END AS student_id", "md5(string(id)) AS school_name"
        )
        sessions = spark.range(0, n, 1, 16).selectExpr(
            "CASE id % 3 WHEN 0 THEN 'hot' ELSE concat('s', id % 5000) END AS student_id", "30.0D AS session_duration", "md5(string(id)) AS note"
        )
        prepared = prepare(sessions, roster).select("student_id", "school_name", "total_hours")
        got = prepared.collect()
        assert len(got) == n
        assert sum(r.total_hours for r in got if r.student_id == "hot") == pytest.approx((n / 3) * (n / 3) * 0.5)
        assert "SortMergeJoin(skew=true)" in plan_of(prepared)
        semi = joins.sessions_on_roster(sessions, roster)
        assert len(semi.collect()) > n / 3
        assert "SortMergeJoin(skew=true)" in plan_of(semi)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_sessions_are_summed_before_any_join(sessions, table, plan_of):
    roster = table([("001",)], "student_id string")
    plan = plan_of(prepare(sessions, roster))
    initial = plan[plan.rfind("Initial Plan") :] if "Initial Plan" in plan else plan
    assert initial.index("Join") < initial.index("HashAggregate")
    assert "Python" not in plan


def _bulk(spark, students, per_student):
    minutes = "CASE id % 3 WHEN 0 THEN 30 WHEN 1 THEN 45 ELSE 60 END"
    sessions = spark.range(students * per_student).selectExpr(
        f"lpad(string(id % {students}), 8, '0') AS student_id", "'math' AS session_topic", f"double({minutes}) AS session_duration"
    )
    roster = spark.range(students).selectExpr("lpad(string(id), 8, '0') AS student_id")
    return sessions, roster


@pytest.mark.parametrize(
    "students, per_student",
    [
        (1_200, 20),
        pytest.param(
            50_000, 20, marks=pytest.mark.skipif(not os.environ.get("TUTORSPARK_STRESS"), reason="set TUTORSPARK_STRESS=1")
        ),
    ],
)
def test_totals_at_scale_points(spark, students, per_student):
    sessions, roster = _bulk(spark, students, per_student)
    n = students * per_student
    minutes = (n + 2) // 3 * 30 + (n + 1) // 3 * 45 + n // 3 * 60
    prepared = prepare(sessions, roster)
    totals = one(prepared.agg(F.count("*").alias("n"), F.sum("total_hours").alias("h"), F.count_if("received_tutoring").alias("t")))
    assert totals["n"] == totals["t"] == students
    assert math.isclose(totals["h"], minutes / 60, rel_tol=1e-12)
    assert one(dosage_metrics(prepared))["tutored_students"] == students
