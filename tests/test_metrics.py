"""Dosage, equity, outcome, cost and cohort numbers against hand-worked values."""

import math
import statistics

import pytest
from conftest import one, rows
from pyspark.sql import functions as F

from tutorspark.functions import bands
from tutorspark.functions.stats import t_two_sided
from tutorspark.operators import cohort, cost, dosage, equity, outcomes, overview


def hours_table(table, *hours):
    return table([(str(i), float(h)) for i, h in enumerate(hours)], "student_id string, total_hours double")


def test_dosage_metrics_leave_out_the_untutored(table):
    got = one(dosage.dosage_metrics(hours_table(table, 0, 30, 60), 60.0))
    assert (got["tutored_students"], got["mean_hours"], got["pct_full_dosage"]) == (2, 45.0, 50.0)
    assert (got["median_hours"], got["q25"], got["q75"], got["iqr"]) == (45.0, 37.5, 52.5, 15.0)
    assert got["gini"] == pytest.approx(1 / 6)
    assert got["target_dosage"] == 60.0


def test_dosage_metrics_of_nobody_are_null(table):
    assert set(one(dosage.dosage_metrics(hours_table(table, 0, 0), 60.0)).values()) == {None}


def test_bands_are_left_closed_and_categories_right_closed(table):
    df = hours_table(table, 15, 30, 45, 60, 60.5)
    shares = one(dosage.dosage_metrics(df, 60.0))
    assert [shares[n] for n in bands.DOSAGE_SHARES] == [0.0, 20.0, 20.0, 20.0, 40.0]
    categories = [r[0] for r in rows(df.orderBy("student_id").select(bands.dosage_category(F.col("total_hours"), 60.0)))]
    assert categories == ["<25%", "25-50%", "50-75%", "75-99%", "100%+"]
    zero = [r[0] for r in rows(hours_table(table, 0, 1).select(bands.dosage_category(F.col("total_hours"), 0.0)))]
    assert zero == [None, "100%+"]


def test_levels_and_bins_differ_on_the_edges(table):
    df = table([(680.0,), (679.9,), (790.0,), (0.0,), (1000.5,), (None,)], "s double")
    assert rows(df.select(bands.score_level(F.col("s")), bands.score_bin(F.col("s")))) == [
        ("Basic", "Below Basic"), ("Below Basic", "Below Basic"), ("Exceeds", "Distinguished"),
        ("Below Basic", None), ("Exceeds", None), (None, None),
    ]


def test_dose_response(table):
    df = table([(0.0,), (20.0,), (55.0,)], "h double")
    h = F.col("h")
    linear, log, threshold = zip(
        *rows(
            df.select(
                bands.dose_response_weight(h, "linear"),
                bands.dose_response_weight(h, "logarithmic"),
                bands.dose_response_weight(h, "threshold"),
            )
        )
    )
    assert linear == (0.0, 20 / 55, 1.0)
    assert log == pytest.approx((0.0, math.log1p(20) / math.log1p(55), 1.0))
    assert threshold == (0.0, 0.0, 1.0)
    other = df.select(
        bands.dose_response_weight(h, "other"),
        bands.dose_response_weight(h, enabled=False),
        bands.dose_response_weight(h, "threshold", 10.0, 20.0),
    )
    assert rows(other) == [(1.0, 1.0, 0.0), (1.0, 1.0, 1.0), (1.0, 1.0, 1.0)]


def test_school_table_merges_schools_of_one_name(table):
    df = table(
        [("1", "A", "x", 60.0), ("2", "A", "y", 0.0), ("3", "B", "z", 30.0), ("4", None, "z", 90.0), ("5", "C", "q", 0.0)],
        "student_id string, school_name string, school_id string, total_hours double",
    )
    got = dosage.school_dosage(df, 60.0)
    assert [(r.school_name, r.total_students, r.students_tutored, r.pct_full_dosage) for r in got.collect()] == [
        ("A", 2, 1, 100.0), ("B", 1, 1, 0.0), ("C", 1, 0, 0.0),
    ]
    printed = dosage.as_printed(got).collect()
    assert printed[0].students_tutored == "1 (50.0%)" and printed[2].pct_50_75 == "0.0%"


def test_subject_table_leaves_out_an_untaught_subject(table):
    prepared = hours_table(table, 1, 0)
    sessions = table([("0", "math", 60.0), ("9", "Math", 1.0)], "student_id string, session_topic string, session_duration double")
    got = dosage.subject_dosage(prepared, sessions, 1.0).collect()
    assert [(r.subject, r.total_students, r.students_tutored, r.pct_tutored, r.pct_full_dosage) for r in got] == [("MATH", 2, 1, 50.0, 100.0)]
    # Sessions of strangers count as "taught".
    ela = table([("9", "ela", 1.0)], "student_id string, session_topic string, session_duration double")
    assert [(r.subject, r.students_tutored) for r in dosage.subject_dosage(prepared, ela, 1.0).collect()] == [("ELA", 0)]


def test_time_views_drop_unreadable_dates_and_count_days_present(table):
    days = ["2026-01-01", "2026-01-02", "2026-01-05", "2026-02-01", "2026-02-02", "2026-02-03", "2026-03-01", "2026-03-02"]
    sessions = table(
        [(str(i), f"{d} 0{i}:30:00", 60.0 * i) for i, d in enumerate(days)] + [("x", "bad", 60.0), (None, "2026-01-01 00:10:00", None)],
        "student_id string, session_date string, session_duration double",
    )
    daily = dosage.daily_sessions(sessions).collect()
    assert [str(r.session_day) for r in daily] == days
    assert (daily[0].session_count, daily[0].unique_students, daily[0].total_hours) == (1, 1, 0.0)
    assert [r.rolling_avg for r in daily] == pytest.approx([0, 0.5, 1, 1.5, 2, 2.5, 3, 4])
    hourly = {r.hour_of_day: (r.total_hours, r.session_count) for r in dosage.hourly_sessions(sessions).collect()}
    assert hourly[0] == (0.0, 1) and hourly[7] == (7.0, 1) and len(hourly) == 8


def test_histogram_keeps_the_maximum_in_the_last_bin(table):
    got = dosage.dosage_histogram(hours_table(table, 0, 10, 20, 40), 60.0).collect()
    assert [(r.bin, r.students) for r in got] == [(1, 1), (11, 1), (30, 1)]
    assert (got[-1].bin_low, got[-1].bin_high) == pytest.approx((39.0, 40.0))
    single = dosage.dosage_histogram(hours_table(table, 5, 5), 60.0).collect()
    assert [(r.bin, r.bin_low, r.bin_high, r.students) for r in single] == [(1, 5.0, 5.0, 2)]


def flag_table(table):
    return table(
        [("1", 0.0, True, None), ("2", 10.0, True, None), ("3", 20.0, False, None), ("4", 0.0, False, True), ("5", 70.0, None, True)],
        "student_id string, total_hours double, ell boolean, iep boolean",
    )


def test_gaps_leave_out_unknown_flags(table):
    gaps = {r.flag: r for r in equity.subgroup_gaps(flag_table(table)).collect()}
    assert (gaps["ell"].n_true, gaps["ell"].n_false, gaps["ell"].gap, gaps["ell"].small_sample) == (1, 1, -10.0, True)
    assert gaps["iep"].gap is None and gaps["iep"].n_true is None
    assert "economic_disadvantage" not in gaps
    assert rows(equity.subgroup_means(flag_table(table))) == [("ELL", "ELL Students", 10.0, 1), ("ELL", "Non-ELL Students", 20.0, 1)]
    assert equity.subgroup_gaps(hours_table(table, 1)).count() == 0


def test_attainment_counts_unknown_flags_as_not_high_need(table):
    got = one(equity.target_attainment(flag_table(table), 60.0))
    assert (got["high_need_n"], got["high_need_full_dosage_pct"]) == (2, 50.0)
    assert (got["total_n"], got["total_full_dosage_pct"]) == (3, pytest.approx(100 / 3))
    nobody = one(equity.target_attainment(hours_table(table, 0)))
    assert nobody["total_n"] is None and nobody["high_need_full_dosage_pct"] is None


def test_ethnicity_medians(table):
    df = table([("X", 1.0), ("X", 2.0), ("X", 9.0), ("X", 10.0), ("Y", 5.0), (None, 7.0), ("Z", 0.0)], "ethnicity string, total_hours double")
    got = {r.ethnicity: (r.avg_hours, r.median_hours, r.pct_full_dosage, r.n) for r in equity.ethnicity_dosage(df, 9.0).collect()}
    assert got == {"X": (5.5, 5.5, 50.0, 4), "Y": (5.0, 5.0, 0.0, 1)}


def test_proficiency_tables(table):
    df = table(
        [("1", 10.0, "Basic"), ("2", 0.0, " Below Basic"), ("3", 5.0, "Below Basic"), ("4", 0.0, "Basic"), ("5", 8.0, "Advanced"),
         ("6", 1.0, " "), ("7", 1.0, None), ("8", 0.0, "Zeta"), ("9", 0.0, "Far below basic")],
        "student_id string, total_hours double, performance_level_most_recent string",
    )
    summary = equity.proficiency_summary(df).collect()
    assert [r.proficiency_level for r in summary] == ["Far below basic", "Below Basic", "Basic", "Advanced", "Zeta"]
    assert [(r.tutored, r.untutored) for r in summary] == [(0, 1), (1, 1), (1, 1), (1, 0), (0, 1)]
    long = equity.proficiency_participation(df).collect()
    assert len(long) == 10
    assert [r.pct_of_category for r in long if r.proficiency_level == "Advanced"] == [100.0, 0.0]
    assert equity.proficiency_summary(hours_table(table, 1)).count() == 0


def test_score_curve_uses_the_third_measure(table):
    df = table(
        [("1", 10.0, 720.0, 700.0), ("2", 0.0, 690.0, 710.0), ("3", 5.0, None, 730.0)],
        "student_id string, total_hours double, ela_outcome_measure_3 double, math_outcome_measure_3 double",
    )
    got = equity.score_participation(df, smoothing_rows=1).collect()
    assert [(r.subject, r.outcome) for r in got] == [("ELA", 690.0), ("ELA", 720.0), ("MATH", 700.0), ("MATH", 710.0), ("MATH", 730.0)]
    assert [r.pct_tutored for r in got] == [0.0, 100.0, 100.0, 0.0, 100.0] == [r.smoothed_pct_tutored for r in got]
    assert sum(r.untutored_count for r in got) == 2
    wide = equity.score_participation(df, smoothing_rows=7).collect()
    assert [r.smoothing_window for r in wide] == [2, 2, 3, 3, 3]
    assert equity.score_participation(hours_table(table, 1)).count() == 0


def test_outcome_metrics(table):
    df = table(
        [("1", 0.0, 99.0, 88.0), ("2", 5.0, 3.0, 6.0)],
        "student_id string, total_hours double, ela_value_added double, ela_raw_gain double",
    )
    got = {r.measure: r for r in outcomes.outcome_metrics(df).collect()}
    assert (got["value_added"].mean, got["value_added"].median, got["value_added"].n) == (3.0, 3.0, 1)
    assert got["raw_gain"].mean == 6.0
    assert got["value_added"].sd is None and got["value_added"].p_value is None and got["value_added"].significant is None


def test_outcome_metrics_against_the_textbook(table):
    values = [4.0, -1.0, 7.0, 2.0, 2.0, 0.0, 5.5]
    df = table([(1.0, v, 5.0) for v in values], "total_hours double, ela_value_added double, math_value_added double")
    got = {r.subject: r for r in outcomes.outcome_metrics(df).collect()}
    mean, sd = statistics.mean(values), statistics.stdev(values)
    ela = got["ela"]
    assert (ela.mean, ela.sd, ela.median) == pytest.approx((mean, sd, 2.0))
    assert ela.effect_size == pytest.approx(mean / sd) and ela.weeks_learning == pytest.approx(43 * mean / sd)
    assert ela.positive_pct == pytest.approx(500 / 7)
    # Two-sided p for six degrees of freedom in closed form.
    t = mean / (sd / math.sqrt(7))
    c2 = 1 / (1 + t * t / 6)
    assert ela.p_value == pytest.approx(1 - (t / math.sqrt(6)) * math.sqrt(c2) * (1 + c2 / 2 + 3 * c2 * c2 / 8), abs=1e-12)
    # No spread: certain when the mean is not zero, no effect size.
    assert (got["math"].p_value, got["math"].significant, got["math"].effect_size) == (0.0, True, None)


def test_t_distribution_closed_forms():
    for t in (0.01, 0.7, 2.0, 9.0):
        assert t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-13)
        assert t_two_sided(-t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-13)
        assert t_two_sided(t, 1e7) == pytest.approx(math.erfc(t / math.sqrt(2)), abs=1e-6)
    assert t_two_sided(0.0, 5) == 1.0


def test_weighted_means_and_labels(table):
    metrics = table(
        [("ela", "value_added", 2.0, 10, 0.2, None, 0.07), ("math", "value_added", 8.0, 30, None, 5.0, 0.01), ("math", "raw_gain", 99.0, 30, 9.0, 9.0, None)],
        "subject string, measure string, mean double, n long, effect_size double, weeks_learning double, p_value double",
    )
    got = one(outcomes.overall_outcomes(metrics))
    assert (got["avg_value_added"], got["avg_effect_size"], got["avg_weeks"]) == (6.5, 0.2, 5.0)
    mean = outcomes.weighted_average("mean").alias("mean")
    assert one(metrics.filter("measure = 'value_added'").agg(mean))["mean"] == 6.5
    assert one(metrics.filter("n > 99").agg(mean))["mean"] is None
    labels = {r.subject: (r.significance, r.direction) for r in outcomes.outcome_labels(metrics).collect()}
    assert labels == {"ela": ("marginal", "directionally positive"), "math": ("significant", "directionally positive")}
    none = {r.subject: (r.significance, r.direction) for r in outcomes.outcome_labels(metrics.limit(0)).collect()}
    assert none == {"ela": (None, "limited"), "math": (None, "limited")}


def cost_table(table):
    return table(
        [("1", 0.0, None, None, None, None), ("2", 10.0, 2.0, 1.0, 4.0, 2.0), ("3", 30.0, 6.0, 3.0, 8.0, 4.0)],
        "student_id string, total_hours double, ela_value_added double, math_value_added double, ela_raw_gain double, math_raw_gain double",
    )


def test_cost_is_shared_out_by_hours(table):
    full = cost_table(table)
    got = one(cost.cost_metrics(full.filter("student_id < '3'"), 4000.0, 20.0, reference=full))
    assert got["tutored_students"] == 1 and got["students_at_target_dosage"] == 0
    assert got["allocated_cost"] == pytest.approx(1000.0)
    assert got["cost_per_student"] == pytest.approx(1000.0)
    assert got["cost_per_hour"] == pytest.approx(100.0)
    assert got["cost_allocation_share"] == pytest.approx(0.25)
    assert got["cost_per_va_point"] == pytest.approx(1000 / 3)
    assert got["cost_per_raw_point"] == pytest.approx(1000 / 6)


def test_cost_counts_losses_and_handles_nobody(table):
    df = table([("1", 1.0, -5.0, 3.0)], "student_id string, total_hours double, ela_value_added double, math_value_added double")
    assert one(cost.cost_metrics(df, 10.0))["cost_per_va_point"] is None
    assert one(cost.cost_metrics(df, 10.0))["cost_per_raw_point"] is None
    assert set(one(cost.cost_metrics(df.filter("total_hours > 5"), 10.0)).values()) == {None}


def test_example_sized_cost(spark):
    df = spark.range(2500).selectExpr("string(id) AS student_id", "CASE WHEN id < 1000 THEN 1.0D + id % 70 ELSE 0.0D END AS total_hours")
    got = one(cost.cost_metrics(df, 2_000_000.0, 60.0, reference=df))
    assert got["tutored_students"] == 1000 and got["cost_per_student"] == pytest.approx(2000.0)


def test_kpis_and_summary(table):
    df = table(
        [("1", "A", "D1", 3, 2.0), ("2", "A", "D1", 3, 4.0), ("3", "B", "D2", None, 0.0)],
        "student_id string, school_name string, district_id string, current_grade_level int, total_hours double",
    )
    assert one(overview.overview_kpis(df)) == {
        "tutored_students": 2, "total_hours": 6.0, "avg_hours": 3.0, "schools_served": 1, "roster_students": 3,
    }
    assert one(overview.roster_kpis(df)) == {"total_students": 3, "tutored_students": 2, "schools": 2, "districts": 2, "grade_levels": 1}
    summary = {r["column"]: r for r in overview.numeric_summary(df).collect()}
    assert (summary["total_hours"].n, summary["total_hours"]["mean"], summary["total_hours"].q25) == (2, 3.0, 2.5)
    # Nobody tutored: all rows are summarised.
    idle = {r["column"]: r.n for r in overview.numeric_summary(df.filter("total_hours = 0")).collect()}
    assert idle == {"total_hours": 1}
    assert [r.student_id for r in overview.preview(df, 2).collect()] == ["1", "2"]


def test_session_kpis(table):
    sessions = table(
        [("1", "Math", "2026-03-01", 30.0, "T1"), ("1", "ela", "bad", None, "T1"), ("2", "science", "2026-01-31 10:00", 60.0, None)],
        "student_id string, session_topic string, session_date string, session_duration double, tutor_id string",
    )
    assert one(overview.session_kpis(sessions)) == {
        "total_sessions": 3, "math_sessions": 1, "ela_sessions": 1, "unique_tutors": 1,
        "first_date": "2026-01-31", "last_date": "2026-03-01", "avg_minutes": 45.0,
    }


def test_flag_dosage_counts_unknown_in_the_rest(table):
    got = {r.flag: (r.mean_flag, r.mean_rest) for r in cohort.flag_dosage(flag_table(table)).collect()}
    assert got == {"ell": (10.0, 45.0), "iep": (70.0, 15.0)}


def test_correlation_of_a_constant_is_null(table):
    df = table([(1.0, 5.0), (2.0, 5.0), (None, 7.0)], "ela_outcome_measure_2 double, math_outcome_measure_2 double")
    assert one(cohort.score_correlation(df))["correlation"] is None
    line = table([(1.0, 5.0), (2.0, 3.0), (3.0, 1.0)], "ela_outcome_measure_2 double, math_outcome_measure_2 double")
    assert one(cohort.score_correlation(line))["correlation"] == pytest.approx(-1.0)


def test_within_student_spread_ignores_single_sessions(table):
    df = table([("1", 30.0), ("1", 50.0), ("2", 99.0)], "student_id string, session_duration double")
    assert one(cohort.within_student_spread(df)) == {"mean_within_student_sd": pytest.approx(math.sqrt(200)), "students": 1}


def test_most_common_hour_prefers_the_earlier(table):
    df = table([("2026-01-03 10:00",), ("2026-01-05 08:00",), ("2026-01-05 10:30",), ("2026-01-04 08:00",)], "session_date string")
    assert one(cohort.session_time_profile(df)) == {"first_hour": 8, "last_hour": 10, "most_common_hour": 8, "weekend_sessions": 2}


def test_grade_bands(table):
    df = table([(-1,), (3,), (5,), (12,), (None,), (13,)], "current_grade_level int")
    got = {r.grade_band: r.n for r in cohort.grade_band_shares(df).collect()}
    assert got == {"Pre-K-2": 1, "Grades 3-5": 2, "Grades 6-8": 0, "Grades 9-12": 1}
