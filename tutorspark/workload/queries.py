"""Every operator as a named query over a folder of Parquet tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tutorspark.functions import bands, parsing
from tutorspark.functions.text import clean
from tutorspark.operators import cohort, cost, dosage, equity, filters, joins, outcomes, overview, readiness
from tutorspark.operators.prepare import (
    duration_hours,
    hours_by_subject,
    hours_per_student,
    hours_per_student_topic,
    latest_outcome,
    prepare,
    roster_with_subject_hours,
)
from tutorspark.operators.validate import Validation, validate
from tutorspark.plans.analysis import FLAG_LABELS, Analysis
from tutorspark.schema import SESSION, STUDENT, SUBJECTS
from tutorspark.session import scratch_folder
from tutorspark.sources.load import Loaded, load_dataset
from tutorspark.sources.normalize import apply_column_map, coerce_types, normalize_columns
from tutorspark.sources.positions import POSITION, number_rows, with_position
from tutorspark.sources.profiles import parse_mapping_profile, profile_column_map
from tutorspark.sources.writers import write_table
from tutorspark.workload import views
from tutorspark.workload.views import ROSTER_COLUMN_MAP, SESSION_COLUMN_MAP

Query = Callable[[SparkSession, str], DataFrame]

TARGET = 60.0
TOTAL_COST = 2_000_000.0
SUBGROUP_FACTORS = {"ell": 1.15, "iep": 1.2, "economic_disadvantage": 1.25}
SAMPLE_K = 400

_QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        _QUERIES[name] = function
        return function

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that summation order does not show."""
    return df.selectExpr(
        *(
            f"round(`{f.name}`, {digits}) AS `{f.name}`" if f.dataType.typeName() == "double" else f"`{f.name}`"
            for f in df.schema.fields
        )
    )


def prepared_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(views.sessions(spark, sf_dir), views.roster(spark, sf_dir))


def on_prepared(name: str, compute: Callable[[DataFrame], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: rounded(compute(prepared_table(spark, sf_dir)))


def on_sessions(name: str, compute: Callable[[DataFrame], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: rounded(compute(views.sessions(spark, sf_dir)))


def on_both(name: str, compute: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """``compute`` gets the session log and the prepared table."""
    _QUERIES[name] = lambda spark, sf_dir: rounded(
        compute(views.sessions(spark, sf_dir), prepared_table(spark, sf_dir))
    )


# -- sources and cleaning -------------------------------------------------------------------------


def normalized(spark: SparkSession, sf_dir: str, dataset: str) -> tuple[DataFrame, object]:
    name, mapping = (
        ("messy_sessions", SESSION_COLUMN_MAP) if dataset == SESSION else ("messy_roster", ROSTER_COLUMN_MAP)
    )
    renamed, applied = apply_column_map(views.view(spark, sf_dir, name), mapping)
    table, report = normalize_columns(renamed, dataset, keep=("row_num",))
    report.applied_column_map = applied
    return table, report


def typed(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    return coerce_types(normalized(spark, sf_dir, dataset)[0], dataset, is_clean=True)


def validated(spark: SparkSession, sf_dir: str, dataset: str) -> Validation:
    table, report = normalized(spark, sf_dir, dataset)
    return validate(table, dataset, report)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster shares, removed when the application ends."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written_and_loaded(spark: SparkSession, sf_dir: str, suffix: str) -> Loaded:
    messy = views.view(spark, sf_dir, "messy_sessions").drop("row_num")
    path = _scratch(spark, "sessions") + suffix
    if suffix == ".csv":
        write_table(messy, SESSION, path)
    elif suffix == ".jsonl":
        messy.write.option("ignoreNullFields", False).json(path)
    else:
        write_table(messy, SESSION, path, "parquet")
    return load_dataset(spark, path, SESSION, SESSION_COLUMN_MAP)


@query("S1_csv_scan")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as CSV, loaded back, typed."""
    return rounded(_written_and_loaded(spark, sf_dir, ".csv").typed)


@query("S2_json_scan")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_written_and_loaded(spark, sf_dir, ".jsonl").typed)


@query("S3_parquet_scan")
def parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_written_and_loaded(spark, sf_dir, ".parquet").typed)


@query("S5_mapping_profile")
def mapping_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5 feeding P1 and P2 on the roster."""
    profile = parse_mapping_profile(
        '{"dataset_profiles": {"student": {"custom_column_map": {"Student_Number": "student_id"}}}}'
    )
    messy = views.view(spark, sf_dir, "messy_roster")
    renamed, _ = apply_column_map(messy, profile_column_map(profile, STUDENT))
    return normalize_columns(renamed, STUDENT, keep=("row_num",))[0].select("row_num", "student_id", "gender")


@query("S6_canonical_order")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder read back as it was written, in canonical column order."""
    table = views.roster(spark, sf_dir)
    path = _scratch(spark, "roster")
    write_table(table.select(*reversed(table.columns)), STUDENT, path, "parquet")
    back = spark.read.parquet(path)
    places = {name: i for i, name in enumerate(back.columns)}
    return back.select(
        "*",
        F.lit(places["student_id"]).alias("id_place"),
        F.lit(places["performance_level_most_recent"]).alias("level_place"),
    )


@query("S7_materialized_prepared")
def materialized_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tutorspark.session import materialize

    kept = materialize(prepared_table(spark, sf_dir), _scratch(spark, "prepared"))
    return rounded(kept.select("student_id", "total_hours", "received_tutoring"))


on_prepared("S8_preview", lambda p: overview.preview(p).select("student_id", "school_name", "total_hours"))


@query("P1_P2_normalized_sessions")
def normalized_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir, SESSION)[0]


@query("P2_P3_normalized_roster")
def normalized_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalized(spark, sf_dir, STUDENT)[0].drop("homeroom")


@query("P4_typed_sessions")
def typed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(typed(spark, sf_dir, SESSION))


@query("P4_typed_roster")
def typed_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(typed(spark, sf_dir, STUDENT).drop("homeroom"))


def cleaned(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return views.view(spark, sf_dir, name).select("row_num", *(clean(c).alias(c) for c in columns))


def _parsed(cell: str, parse: Callable[[str], Column], check: Callable[[str], Column]) -> list[Column]:
    return [parse(cell).alias("value"), check(cell).alias("valid")]


@query("P5_flags")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cleaned(spark, sf_dir, "messy_roster", "english_learner")
    return cells.select("row_num", *_parsed("english_learner", parsing.flag, parsing.flag_is_valid))


@query("P6_grades")
def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cleaned(spark, sf_dir, "messy_roster", "current_grade_level")
    return cells.select("row_num", *_parsed("current_grade_level", parsing.grade, parsing.grade_is_valid))


@query("P7_numbers")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("ela_state_score_current_year", "math_outcome_score_current_year")
    return rounded(
        cleaned(spark, sf_dir, "messy_roster", *names).select(
            "row_num",
            *(parsing.number(n).alias(f"{n[:4]}_value") for n in names),
            *(parsing.number_is_valid(n).alias(f"{n[:4]}_valid") for n in names),
        )
    )


@query("P8_datetimes")
def datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cleaned(spark, sf_dir, "messy_sessions", "session_date")
    return cells.select("row_num", *_parsed("session_date", parsing.timestamp, parsing.timestamp_is_valid)).withColumn(
        "value", F.date_format("value", "yyyy-MM-dd HH:mm:ss")
    )


@query("P9_topics")
def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = cleaned(spark, sf_dir, "messy_sessions", "topic")
    return cells.select("row_num", *_parsed("topic", parsing.topic, parsing.topic_is_valid))


@query("P10_lowered_names")
def lowered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tutorspark.functions.text import lowered

    return (
        views.view(spark, sf_dir, "messy_roster")
        .groupBy(lowered("school_name").alias("school"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


on_prepared(
    "P11_outcome_columns",
    lambda p: p.select(
        "student_id", *(f"{s}_{m}" for s in SUBJECTS for m in ("latest_outcome", "raw_gain", "value_added"))
    ),
)
on_prepared(
    "P12_latest_outcome",
    lambda p: p.drop("ela_latest_outcome").transform(
        lambda d: d.select("student_id", latest_outcome(d, "ela").alias("ela"))
    ),
)
on_sessions(
    "P13_session_hours",
    lambda s: s.groupBy("session_topic").agg(
        F.sum(duration_hours(s)).alias("hours"), F.max(duration_hours(s)).alias("longest")
    ),
)
on_prepared(
    "P14_received_tutoring",
    lambda p: p.withColumn("received_tutoring", F.col("received_tutoring").cast("string")).transform(
        lambda d: d.select("student_id", bands.received_tutoring(d).alias("received"))
    ),
)
on_prepared(
    "P15_hours_column",
    lambda p: p.withColumn("total_hours", F.nullif("total_hours", F.lit(0.0))).transform(
        lambda d: d.select("student_id", bands.hours(d).alias("hours"))
    ),
)
on_sessions(
    "P16_hour_and_day",
    lambda s: s.groupBy(
        F.hour("session_ts").alias("hour_of_day"),
        F.date_format(F.to_date("session_ts"), "yyyy-MM-dd").alias("session_day"),
    ).agg(F.count(F.lit(1)).alias("n")),
)
on_prepared(
    "P17_level_rank",
    lambda p: p.select(
        "student_id", bands.proficiency_rank(F.col("performance_level_most_recent")).alias("level_rank")
    ).filter("level_rank is not null"),
)


def _resolved(p: DataFrame) -> DataFrame:
    scores = equity.outcome_columns(p.columns)
    level = equity.performance_column(p.columns)
    return p.select(
        "student_id", F.col(level).alias("level"), *(F.col(c).alias(f"{s}_score") for s, c in scores.items())
    )


on_prepared("P18_resolved_columns", _resolved)
on_prepared(
    "P19_dosage_category",
    lambda p: p.select("student_id", bands.dosage_category(bands.hours(p), TARGET).alias("category")),
)
on_prepared(
    "P20_score_level",
    lambda p: p.select(
        "student_id", bands.score_level(F.col("ela_latest_outcome")).alias("ela_level"),
        bands.score_level(F.col("math_outcome_measure_2")).alias("math_level"),
    ),
)
on_prepared(
    "P21_score_bin",
    lambda p: p.select("student_id", bands.score_bin(cohort.prior_score(p)).alias("score_bin")),
)
on_prepared(
    "P22_dose_response",
    lambda p: p.select(
        "student_id",
        *(
            bands.dose_response_weight(bands.hours(p), kind, 55.0, 30.0).alias(kind)
            for kind in ("linear", "logarithmic", "threshold")
        ),
    ),
)
on_prepared(
    "P23_subgroup_multiplier",
    lambda p: p.select(
        "student_id",
        bands.subgroup_multiplier(p, SUBGROUP_FACTORS).alias("multiplier"),
        bands.enrolment_probability(p, SUBGROUP_FACTORS, 0.6).alias("probability"),
    ),
)

# -- filters --------------------------------------------------------------------------------------

_ETHNICITIES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _ids(df: DataFrame) -> DataFrame:
    return df.select("student_id", "total_hours")


on_prepared("F1_tutored", lambda p: _ids(filters.tutored_students(p)))
on_prepared("F2_school", lambda p: _ids(filters.school_filter(p, "NATION_3")))
on_prepared("F3_grades", lambda p: _ids(filters.grade_filter(p, list(range(-1, 13)))))
on_prepared("F4_unknown_flag", lambda p: _ids(filters.tri_state_filter(p, "ell", "Unknown")))
on_prepared("F4_false_flag", lambda p: _ids(filters.tri_state_filter(p, "iep", "No")))
on_prepared("F5_every_option", lambda p: _ids(filters.in_list_filters(p, {"ethnicity": _ETHNICITIES})))
on_prepared("F5_some_options", lambda p: _ids(filters.in_list_filters(p, {"ethnicity": _ETHNICITIES[:2]})))
on_prepared(
    "F6_combined",
    lambda p: _ids(
        filters.apply_filter_values(
            p,
            {
                "school_name": "All",
                "current_grade_level": [3, 4, 5, 6, 7],
                "gender": ["Female", "Male"],
                "ethnicity": _ETHNICITIES,
                "economic_disadvantage": "Yes",
                "homeroom": ["x"],
            },
        )
    ),
)
on_prepared(
    "F7_fixed_keys",
    lambda p: _ids(
        filters.apply_filters(
            p, {"school": "All", "grades": [0, 1, 2, 8], "ell": False, "gender": ["Female", "Nonbinary"]}
        )
    ),
)
on_prepared("F8_filter_options", lambda p: filters.filter_options(p, "equity"))
on_prepared(
    "F9_nonblank_levels", lambda p: _ids(p.filter(clean("performance_level_most_recent").isNotNull()))
)


@query("F10_dated_sessions")
def dated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy dates, parsed when the time view asks for them."""
    kept = dosage.timed_sessions(typed(spark, sf_dir, SESSION))
    return rounded(
        kept.groupBy(F.date_format("session_ts", "yyyy-MM-dd").alias("session_day")).agg(
            F.count(F.lit(1)).alias("n"), bands.summed_hours(F.col("minutes")).alias("hours")
        )
    )


@query("F5_long_list")
def long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of all ids that there are is no filter, so students without an id stay; a short list is."""
    students = typed(spark, sf_dir, STUDENT)
    ids = views.table(spark, sf_dir, "customer").filter("c_custkey % 113 <> 0").selectExpr("lpad(string(c_custkey), 10, '0') AS id")
    kept = filters.in_list_filters(students, {"student_id": ids, "gender": ["Female", "Nonbinary"]})
    return kept.groupBy("gender").agg(
        F.count(F.lit(1)).alias("students"), F.count_if(F.col("student_id").isNull()).alias("without_id")
    )


on_sessions(
    "F11_topic_counts",
    lambda s: overview.session_kpis(s).select("total_sessions", "math_sessions", "ela_sessions"),
)
on_prepared("F12_high_need", lambda p: _ids(p.filter(bands.high_need(p))))

# -- joins ----------------------------------------------------------------------------------------

on_prepared("J1_roster_hours", _ids)


def _messy_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sessions and roster as delivered: either may lack ids that the other has."""
    return typed(spark, sf_dir, SESSION), typed(spark, sf_dir, STUDENT)


@query("J2_sessions_on_roster")
def sessions_on_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = joins.sessions_on_roster(*_messy_pair(spark, sf_dir))
    return kept.groupBy("student_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("tutor_id").alias("tutors")
    )


on_prepared("J3_prepared", lambda p: p.drop("district_id", "district_name", "school_id"))
on_both(
    "J4_subject_hours",
    lambda s, p: roster_with_subject_hours(p, s).select("student_id", "total_hours", *SUBJECTS),
)
on_prepared(
    "J5_treated_and_control",
    lambda p: joins.treated(p)
    .select("student_id", F.lit("treated").alias("side"))
    .unionByName(joins.control(p).select("student_id", F.lit("control").alias("side"))),
)


@query("J5_split_by_ids")
def split_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, rest = joins.split_by_ids(views.roster(spark, sf_dir), views.sessions(spark, sf_dir))
    one = F.count(F.lit(1)).alias("students")
    return members.agg(F.lit("members").alias("side"), one).unionByName(rest.agg(F.lit("rest").alias("side"), one))


@query("J6_session_grades")
def session_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = joins.sessions_with_grade(*_messy_pair(spark, sf_dir))
    return graded.groupBy("current_grade_level").agg(
        F.count(F.lit(1)).alias("n"), F.count("student_id").alias("with_id")
    )


on_prepared(
    "J7_grade_bands",
    lambda p: joins.with_grade_band(p, bands.ROSTER_GRADE_BANDS).select("student_id", "grade_band"),
)
on_prepared("J8_level_status_grid", equity.proficiency_participation)

# -- aggregations ---------------------------------------------------------------------------------

on_sessions("A1_hours_per_student", hours_per_student)
on_sessions("A2_hours_per_topic", hours_per_student_topic)
on_sessions("A3_hours_by_subject", hours_by_subject)
on_prepared("A4_dosage_metrics", lambda p: dosage.dosage_metrics(p, TARGET))


def _shares(p: DataFrame) -> DataFrame:
    return p.agg(
        *(c.alias(n) for n, c in dosage.band_shares(bands.hours(p), bands.is_tutored(p), TARGET).items())
    )


on_prepared("A5_band_shares", _shares)
on_prepared("A6_gini", lambda p: dosage.dosage_metrics(p, TARGET).select("gini", "tutored_students"))
on_prepared("A7_school_dosage", lambda p: dosage.school_dosage(p, TARGET))
on_prepared("A7_school_dosage_printed", lambda p: dosage.as_printed(dosage.school_dosage(p, TARGET)))
on_both("A8_subject_dosage", lambda s, p: dosage.subject_dosage(p, s, 30.0))
on_prepared("A9_subgroup_gaps", lambda p: equity.subgroup_gaps(p).drop("small_sample"))
on_prepared("A10_target_attainment", lambda p: equity.target_attainment(p, TARGET))
on_prepared("A11_ethnicity_dosage", lambda p: equity.ethnicity_dosage(p, TARGET))
on_prepared("A12_subgroup_means", equity.subgroup_means)
on_prepared("A13_small_samples", lambda p: equity.subgroup_gaps(p).select("flag", "n_true", "n_false", "small_sample"))
on_prepared("A14_outcome_metrics", lambda p: outcomes.outcome_metrics(p).drop("p_value", "significant"))
on_prepared(
    "A14_outcome_metrics_wide",
    lambda p: outcomes.wide_outcome_metrics(outcomes.outcome_metrics(p)),
)
on_prepared(
    "A15_p_values",
    lambda p: outcomes.outcome_metrics(p)
    .filter("measure = 'value_added'")
    .select("subject", "p_value", "significant"),
)
on_prepared("A16_overall_outcomes", lambda p: outcomes.overall_outcomes(outcomes.outcome_metrics(p)))
on_prepared("A17_outcome_labels", lambda p: outcomes.outcome_labels(outcomes.outcome_metrics(p)))
on_prepared(
    "A18_cost_metrics",
    lambda p: cost.cost_metrics(filters.school_filter(p, "NATION_3"), TOTAL_COST, TARGET, reference=p),
)
on_prepared("A19_proficiency_summary", equity.proficiency_summary)
on_prepared("A20_score_participation", equity.score_participation)
on_prepared("A21_population", filters.population_summary)
on_prepared("A22_overview_kpis", overview.overview_kpis)
on_sessions("A23_session_kpis", overview.session_kpis)
on_prepared("A24_roster_kpis", overview.roster_kpis)
on_sessions("A25_hourly_sessions", dosage.hourly_sessions)
on_sessions(
    "A26_daily_sessions",
    lambda s: dosage.daily_sessions(s).withColumn("session_day", F.date_format("session_day", "yyyy-MM-dd")),
)
on_prepared(
    "A27_unknown_shares",
    lambda p: filters.unknown_shares(filters.tutored_students(p), FLAG_LABELS),
)
on_prepared("A28_numeric_summary", overview.numeric_summary)
on_prepared("A29_dosage_histogram", lambda p: dosage.dosage_histogram(p, TARGET))
on_prepared("A30_outcome_histogram", lambda p: outcomes.outcome_histogram(p, "math"))
on_prepared("A31_flag_rates", cohort.flag_rates)
on_prepared("A32_flag_enrolment", cohort.flag_enrolment)
on_prepared("A33_enrolment_by_score", cohort.enrolment_by_prior_score)
on_prepared("A34_grade_band_shares", cohort.grade_band_shares)
on_prepared("A35_dosage_moments", cohort.dosage_moments)
on_prepared("A36_flag_dosage", cohort.flag_dosage)
on_prepared("A37_treatment_effect", cohort.treatment_effect)
on_prepared("A38_score_correlation", cohort.score_correlation)
on_both("A39_sessions_per_treated", cohort.sessions_per_treated)
on_sessions("A40_ratio_shares", cohort.ratio_shares)
on_both("A41_topic_share_by_band", cohort.topic_share_by_grade_band)
on_sessions("A42_session_times", cohort.session_time_profile)
on_sessions("A43_within_student_spread", cohort.within_student_spread)


def _enrolment_weight(p: DataFrame) -> Column:
    return bands.enrolment_probability(p, SUBGROUP_FACTORS, 0.4)


def _sample(p: DataFrame, k: int | None) -> DataFrame:
    return cohort.weighted_sample(p, _enrolment_weight(p), k, keys=["student_id"]).select("student_id")


on_prepared("A44_weighted_sample", lambda p: _sample(p, SAMPLE_K))
on_prepared("A44_independent_sample", lambda p: _sample(p, None))


@query("A44_missing_and_repeated_ids")
def sample_of_missing_and_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the ids is missing, and two ids have a tenth of the rows each."""
    students = views.table(spark, sf_dir, "customer").selectExpr(
        """CASE WHEN c_custkey % 10 > 2 THEN lpad(string(c_custkey), 10, '0')
           WHEN c_custkey % 10 > 0 THEN lpad(string(c_custkey % 10), 10, '0') END AS student_id""",
        "c_nationkey % 5 AS district",
    )
    sample = cohort.weighted_sample(students, F.lit(1.0) + F.col("district") % 2, 100)
    return sample.groupBy("student_id", "district").agg(F.count(F.lit(1)).alias("n"))


@query("A1_band_edges")
def band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer has exactly the target, in sessions of 5 to 50 minutes."""
    sessions = views.table(spark, sf_dir, "customer").selectExpr(
        "string(c_custkey) AS student_id", "double(element_at(array(20, 50, 25, 40, 10, 45, 5), int(c_custkey % 7) + 1)) AS session_duration"
    )
    sessions = sessions.selectExpr("*", f"explode(sequence(1, int({TARGET} * 60 / session_duration)))")
    lengths = sessions.groupBy("student_id").agg(F.max("session_duration").alias("session_minutes"))
    hours = hours_per_student(sessions).join(lengths, "student_id")
    return hours.groupBy("session_minutes").agg(
        F.count(F.lit(1)).alias("students"),
        F.count_if(F.col("total_hours") >= TARGET).alias("at_target"),
        F.max("total_hours").alias("hours"),
    )

# -- windows --------------------------------------------------------------------------------------

on_sessions(
    "W1_rolling_week",
    lambda s: dosage.daily_sessions(s).select(
        F.date_format("session_day", "yyyy-MM-dd").alias("session_day"), "rolling_avg"
    ),
)
on_prepared(
    "W2_even_window",
    lambda p: equity.score_participation(p, smoothing_rows=4).select(
        "subject", "outcome", "smoothed_pct_tutored", "smoothing_students", "smoothing_window"
    ),
)
on_prepared("W3_ranked_hours", lambda p: dosage.hours_ranking(p).select("hours", "n", "before_n", "total_n"))


@query("W4_row_numbers")
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each record in its file, from split positions alone."""
    positioned = with_position(views.table(spark, sf_dir, "events"))
    return number_rows(positioned.select("event_id", POSITION), positioned).drop("file")


# -- sorted tables ----------------------------------------------------------------------------------


def _placed(table: DataFrame) -> DataFrame:
    """A sorted table with the place of each row; one partition reads the sorted ones in their order."""
    return table.coalesce(1).withColumn("place", F.monotonically_increasing_id())


on_prepared("O1_school_order", lambda p: _placed(dosage.school_dosage(p, TARGET).select("school_name")))
on_both("O2_subject_order", lambda s, p: _placed(dosage.subject_dosage(p, s, 30.0).select("subject")))
on_prepared("O3_level_order", lambda p: _placed(equity.proficiency_summary(p).select("proficiency_level")))

# -- validation and reports -----------------------------------------------------------------------


def on_validation(name: str, dataset: str, compute: Callable[[Validation], DataFrame]) -> None:
    _QUERIES[name] = lambda spark, sf_dir: rounded(compute(validated(spark, sf_dir, dataset)))


@query("V1_critical_issues")
def critical_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: a table without rows has the one critical finding, here the sessions or rows of nobody."""
    found = []
    for dataset in (SESSION, STUDENT):
        table, report = normalized(spark, sf_dir, dataset)
        for rows, part in (("all", table), ("nobody", table.filter(F.col("student_id") == "nobody"))):
            counts = validate(part, dataset, report).message_counts
            found.append(counts.select(F.lit(dataset).alias("dataset"), F.lit(rows).alias("rows"), "critical_issues"))
    return reduce(DataFrame.unionByName, found)


def _report_lines(v: Validation) -> DataFrame:
    """The report in reading order; the samples in it are V10's."""
    return v.messages.filter("section <> 71").select("dataset", "severity", "section", "line", "message")


on_validation("V3_V5_name_messages", SESSION, _report_lines)
on_validation("V6_missing_session_values", SESSION, lambda v: v.missing_values)
on_validation("V6_missing_student_values", STUDENT, lambda v: v.missing_values)
on_validation("V7_session_issues", SESSION, lambda v: v.issues)
on_validation("V7_session_rule_counts", SESSION, lambda v: v.rule_counts)
@query("V7_malformed_records")
def malformed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a cell too many or too few, in a folder of several files: each finding has its own place."""
    lines = views.table(spark, sf_dir, "events").selectExpr(
        "event_id",
        """CASE WHEN event_id % 50 = 7 THEN concat('S', event_id, ',math,2026-01-15,30,T1,extra')
           WHEN event_id % 70 = 9 THEN concat('S', event_id, ',ela,2026-01-15,45')
           ELSE concat('S', event_id, ',ela,2026-01-15 09:00,60,T2') END AS value""",
    )
    path = _scratch(spark, "ragged") + ".csv"
    # Each file begins with the header, as separate uploads would; the lines are written as they are.
    files = lines.repartition(4, "event_id").sortWithinPartitions("event_id").select("value")
    header = ["student_id", "session_topic", "session_date", "session_duration", "tutor_id"]
    files.withColumnRenamed("value", ",".join(header)).write.option("header", True).option("sep", "\x01").csv(path)
    found = load_dataset(spark, path, SESSION).validation.issues
    return found.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("file", "row_num").alias("places"),
        F.when(F.count_distinct("file") > 1, 1).otherwise(0).alias("several_files"),
        F.count_if(F.contains("message", "file")).alias("named"),
    )


on_validation("V8_student_issues", STUDENT, lambda v: v.issues)
on_validation("V8_student_rule_counts", STUDENT, lambda v: v.rule_counts)
on_validation("V9_category_counts", STUDENT, lambda v: v.category_counts)
on_validation("V10_session_sample", SESSION, lambda v: v.sample.drop("rule_ord"))
on_validation("V10_student_sample", STUDENT, lambda v: v.sample.drop("rule_ord"))
on_validation("V11_normalization_summary", SESSION, lambda v: v.normalization_summary())


@query("V11_normalization_details")
def normalization_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header report of both tables, with the number of filled cells behind each canonical column."""
    result = None
    for dataset in (SESSION, STUDENT):
        v = validated(spark, sf_dir, dataset)
        canonical = list(v.report.alias_sources)
        filled = v.table.agg(
            F.array(
                *(F.struct(F.lit(c).alias("canonical_column"), F.count(c).alias("filled")) for c in canonical)
            ).alias("cells")
        ).select(F.explode("cells").alias("c")).select("c.*")
        part = v.normalization_details().join(filled, "canonical_column", "left")
        result = part if result is None else result.unionByName(part)
    return result


on_both("V12_readiness", lambda s, p: readiness.readiness(p, s))


on_both(
    "V12_partial_readiness",
    lambda s, p: readiness.readiness(p.drop("economic_disadvantage", "ethnicity"), s).filter("status <> 'Ready'"),
)


@query("filtered_dosage_tab")
def filtered_dosage_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The school table of the dosage tab under a filter on grade and gender."""
    tab = Analysis.of(
        views.sessions(spark, sf_dir),
        views.roster(spark, sf_dir),
        keep=False,
        filters={"current_grade_level": [1, 2, 3, 4, 5, 6], "gender": ["Female"]},
        target=TARGET,
    ).dosage()
    return rounded(tab["schools"])
