"""V1-V12."""

import pytest
from conftest import one, rows

from tutorspark.operators import readiness
from tutorspark.operators.validate import validate
from tutorspark.sources.load import load_dataset, load_frame

SESSION_HEADER = "student_id,session_topic,session_date,session_duration,tutor_id"


def load_csv(spark, path, dataset, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return load_dataset(spark, str(path), dataset)


def text(validation, severity=None):
    lines = validation.messages.orderBy("section", "line").collect()
    return [r.message for r in lines if severity in (None, r.severity)]


def test_bad_session_row_is_named(spark, tmp_path, plan_of):
    loaded = load_csv(
        spark, tmp_path / "s.csv", "session", SESSION_HEADER, "p1,Reading,2/3/2025,0.5,t", "p2,chess,2025-02-30,1h,t"
    )
    issues = {r.rule: r for r in loaded.validation.issues.collect()}
    assert set(issues) == {"unsupported_topic", "invalid_date", "not_numeric"}
    assert {r.row_num for r in issues.values()} == {3}
    warnings = "\n".join(text(loaded.validation, "warning"))
    for part in ("`session_topic` is 'chess'", "`session_date` is '2025-02-30'", "`session_duration` is '1h', expected a number of minutes"):
        assert part in warnings
    assert warnings.count("Row 3 of file:") == 3 and warnings.count("s.csv: ") == 3
    assert "Python" not in plan_of(loaded.validation.issues)


def test_blank_cells_are_counted_but_only_ids_are_row_findings(spark, tmp_path):
    loaded = load_csv(spark, tmp_path / "s.csv", "session", SESSION_HEADER, ",, ,,", "1,MATHS,2026-01-10,-5,T1")
    v = loaded.validation
    assert dict(rows(v.missing_values.select("field", "missing"))) == {
        "student_id": 1, "session_topic": 1, "session_date": 1, "session_duration": 1, "tutor_id": 1,
    }
    found = sorted((r.rule, r.field, r.row_num) for r in v.issues.collect())
    assert found == [("missing", "student_id", 2), ("missing", "tutor_id", 2), ("negative", "session_duration", 3)]
    counts = {(r.rule, r.field): r.n for r in v.rule_counts.collect()}
    assert counts[("negative", "session_duration")] == 1 and counts[("invalid_date", "session_date")] == 0
    assert len(counts) == 7 and counts[("malformed_record", "")] == 0
    assert "  `tutor_id`: 1 missing values" in text(v)


def test_student_rules_and_categories(spark, tmp_path):
    lines = ["student_id,district_id,school_id,current_grade_level,gender,ell,ela_outcome_measure_1"]
    lines += [f"{i},1,1,3,g{i},TRUE,700" for i in range(6)]
    lines += [",,,13,g0,maybe,x", "7,1,1,3.5,g0,n/a,", "8,1,1,,g0,,1e2"]
    v = load_csv(spark, tmp_path / "st.csv", "student", *lines).validation
    found = sorted((r.row_num, r.rule, r.field, r.value) for r in v.issues.collect())
    assert found == sorted(
        [
            (8, "missing", "student_id", None), (8, "missing", "district_id", None), (8, "missing", "school_id", None),
            (8, "grade_out_of_range", "current_grade_level", "13"), (8, "not_a_flag", "ell", "maybe"),
            (8, "not_numeric", "ela_outcome_measure_1", "x"), (9, "not_a_grade", "current_grade_level", "3.5"),
            (10, "missing", "current_grade_level", None),
        ],
        key=lambda f: (f[0], f[1], f[2], f[3]),
    )
    assert rows(v.category_counts) == [("student", "gender", 6, 5, True)]
    assert any(m.startswith("`gender` has 6 unique values") for m in text(v, "warning"))


def test_sample_is_capped_and_ordered(spark, table):
    sessions = table(
        [(i + 2, None if i % 2 else str(i), "chess", "1", "T") for i in range(30)],
        "row_num int, student_id string, session_topic string, session_duration string, tutor_id string",
    )
    sample = validate(sessions, "session").sample.orderBy("rule_ord", "row_num").collect()
    assert len(sample) == 20
    assert [r.rule for r in sample] == ["missing"] * 15 + ["unsupported_topic"] * 5
    students = table([(i + 2, "", "x") for i in range(30)], "row_num int, student_id string, ell string").replace("", None)
    by_row = validate(students, "student").sample.orderBy("row_num", "rule_ord").collect()
    assert [(r.row_num, r.rule) for r in by_row[:4]] == [(2, "missing"), (2, "not_a_flag"), (3, "missing"), (3, "not_a_flag")]
    assert "  ... and 40 more issues" in text(validate(students, "student"))
    assert len([m for m in text(validate(students, "student")) if m.startswith("Row ")]) == 20


def test_empty_table_is_the_one_critical_finding(spark, tmp_path):
    v = load_csv(spark, tmp_path / "s.csv", "session", SESSION_HEADER).validation
    assert text(v) == ["The file is empty or could not be read."]
    assert one(v.message_counts) == {"critical_issues": 1, "warnings": 0, "info_messages": 0}


def test_unknown_kind_is_an_error(table):
    with pytest.raises(ValueError):
        validate(table([("1",)], "student_id string"), "tutor")


def test_header_findings(table):
    extra = ", ".join(f"x{i} string" for i in range(12))
    df = table([("1", "F") + ("v",) * 12], f"`Student_ID` string, sex string, {extra}")
    v = load_frame(df, "student").validation
    assert v.missing_core_columns() == ["district_id", "district_name", "school_id", "school_name", "current_grade_level"]
    assert v.missing_module_columns()["dosage"] == ["ethnicity"]
    assert len(v.unexpected_columns()) == 12
    messages = text(v)
    assert "  `x9` (accepted, not used)" in messages and "  ... and 2 more" in messages
    assert "Accepted alternative column names: `gender` from `sex`" in messages
    assert not any("x10" in m for m in messages)


def test_normalization_report(table):
    df = table([("1", "x")], "`Student Number` string, unused_col string")
    loaded = load_frame(df, "student", {"student number": "student_id"})
    summary = one(loaded.validation.normalization_summary())
    assert summary["dataset"] == "Student" and summary["uploaded_rows"] == 1
    assert (summary["canonical_columns"], summary["unknown_columns"], summary["profile_mappings_applied"]) == (2, 1, 1)
    alias = load_frame(table([("F", "M", "1")], "sex string, gender string, ell string"), "student")
    assert one(alias.validation.normalization_summary())["renamed_columns"] == 1
    status = {r.canonical_column: r.status for r in alias.validation.normalization_details().collect()}
    assert status == {"gender": "Merged alias columns", "ell": "Accepted as canonical"}
    details = loaded.validation.normalization_details().collect()
    assert ("", "unused_col", "Not used by current schema") in [tuple(r)[1:] for r in details]
    mapped = load_frame(table([("F",)], "sex string"), "student").validation.normalization_details()
    assert one(mapped)["status"] == "Mapped from alias"


def prepared(table, drop=()):
    df = table(
        [("1", "A", 10.0, "X", True, False, True, "Basic", 700.0, None, 5.0, 2.0, 4.0, 1.0),
         ("2", "B", 20.0, "Y", False, True, None, "Proficient", 710.0, None, 6.0, 3.0, 7.0, 2.0)],
        "student_id string, school_name string, total_hours double, ethnicity string, ell boolean, iep boolean, "
        "economic_disadvantage boolean, performance_level_most_recent string, ela_latest_outcome double, math_latest_outcome double, "
        "ela_raw_gain double, ela_value_added double, math_raw_gain double, math_value_added double",
    )
    return df.drop(*drop)


def sessions(table):
    return table(
        [("1", "ela", 60.0, "2026-01-15 09:00:00"), ("2", "math", 45.0, None)],
        "student_id string, session_topic string, session_duration double, session_date string",
    )


def test_readiness(table):
    got = readiness.readiness(prepared(table, ["economic_disadvantage"]), sessions(table)).collect()
    assert len(got) == 15
    by = {(r.tab, r.section): r for r in got}
    assert by[("Dosage & Access", "Tab summary")].status == "Ready"
    assert by[("Dosage & Access", "Tab summary")].detail == "All tracked sections available."
    assert by[("Equity Analysis", "Subgroup dosage gaps")].status == "Partial"
    assert by[("Equity Analysis", "Tab summary")].status == "Partial"
    # Present but empty columns show in the coverage only.
    latest = by[("Equity Analysis", "Tutoring likelihood by latest outcome")]
    assert (latest.status, latest.coverage) == ("Ready", 0.0)
    assert by[("Dosage & Access", "Time-of-day and over-time implementation views")].coverage == 0.5
    notes = rows(readiness.tab_notes(readiness.readiness(prepared(table, ["ethnicity"]), sessions(table)), "Equity Analysis"))
    assert notes == [("Equity Analysis", "Ethnicity dosage comparison: Missing: ethnicity")]


def test_readiness_with_almost_nothing(table):
    got = readiness.readiness(table([("1",)], "student_id string"), table([(1,)], "x int")).collect()
    assert {r.status for r in got} == {"Unavailable"}
    assert all(r.coverage is None for r in got)


def test_findings_and_line_numbers_come_from_one_scan(spark, tmp_path, plan_of):
    """Issues, their sample and their line numbers, over files of many splits."""
    lines = [f"{n},{'math' if n % 7 else 'art'},2025-01-02,{30 if n % 11 else 'x'},t" for n in range(400)]
    (tmp_path / "s.csv").write_text("student_id,session_topic,session_date,session_duration,tutor_id\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        found = load_dataset(spark, str(tmp_path / "s.csv"), "session").validation
        for table in (found.issues, found.sample):
            assert plan_of(table).split("Initial Plan")[0].count("FileScan") == 1
        got = sorted((r.row_num, r.rule) for r in found.issues.collect())
        sample = [(r.rule, r.row_num) for r in found.sample.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = sorted([(n + 2, "unsupported_topic") for n in range(0, 400, 7)] + [(n + 2, "not_numeric") for n in range(0, 400, 11)])
    assert got == want and sorted(sample) == [("unsupported_topic", n + 2) for n in range(0, 140, 7)]
