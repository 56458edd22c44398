"""Equity: dosage and participation between groups of students."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.functions import bands
from tutorspark.functions.bands import DEFAULT_TARGET_HOURS, flag_is, high_need, proficiency_rank
from tutorspark.functions.parsing import typed_number
from tutorspark.functions.stats import share
from tutorspark.functions.text import clean, strip
from tutorspark.operators.filters import tutored_students
from tutorspark.operators.ranking import (
    aggregate_with_quantiles,
    centred_rolling_sums,
    value_counts,
)
from tutorspark.schema import EQUITY_FLAGS, SUBJECTS, outcome_measures
from tutorspark.sources.literals import literal_table

SMALL_SAMPLE = 30
SMOOTHING_ROWS = 7

# Group and subgroup names of the long table.
SUBGROUP_NAMES = {
    "ell": ("ELL", "ELL Students", "Non-ELL Students"),
    "iep": ("IEP", "IEP Students", "Non-IEP Students"),
    "economic_disadvantage": (
        "Economic Status",
        "Economically Disadvantaged",
        "Not Economically Disadvantaged",
    ),
}


def _flag_sides(df: DataFrame) -> tuple[list[str], DataFrame]:
    """Hours and counts of TRUE and FALSE rows per flag present: one row, one pass, no expansion."""
    flags = [f for f in EQUITY_FLAGS if f in df.columns]
    h = bands.hours(df)
    aggregates = []
    for f in flags:
        for side, target in (("true", True), ("false", False)):
            aggregates.append(F.avg(F.when(flag_is(df, f, target), h)).alias(f"{f}_{side}_mean"))
            aggregates.append(F.count_if(flag_is(df, f, target)).alias(f"{f}_{side}_n"))
    return flags, tutored_students(df).agg(F.count(F.lit(1)).alias("n"), *aggregates)


def subgroup_gaps(df: DataFrame) -> DataFrame:
    """A9 with A13: per flag, mean hours of TRUE and FALSE among tutored students and their gap.

    Unknown flags are on neither side.  A flag with an empty side has a row of NULLs, or no row
    at all when the column is absent.
    """
    flags, sides = _flag_sides(df)
    if not flags:
        return literal_table(
            df.sparkSession,
            [],
            "flag string, mean_true double, mean_false double, gap double, n_true long, n_false long, "
            "small_sample boolean",
        )
    rows = []
    for f in flags:
        n_true, n_false = F.col(f"{f}_true_n"), F.col(f"{f}_false_n")
        both = (n_true > 0) & (n_false > 0)
        rows.append(
            F.struct(
                F.lit(f).alias("flag"),
                F.when(both, F.col(f"{f}_true_mean")).alias("mean_true"),
                F.when(both, F.col(f"{f}_false_mean")).alias("mean_false"),
                F.when(both, F.col(f"{f}_true_mean") - F.col(f"{f}_false_mean")).alias("gap"),
                F.when(both, n_true).alias("n_true"),
                F.when(both, n_false).alias("n_false"),
                F.when(both, is_small_sample(n_true) | is_small_sample(n_false)).alias("small_sample"),
            )
        )
    return sides.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def is_small_sample(n: Column) -> Column:
    """A13."""
    return n < F.lit(SMALL_SAMPLE)


def subgroup_means(df: DataFrame) -> DataFrame:
    """(group_name, subgroup, average_hours, n), two rows per flag with both sides present."""
    gaps = subgroup_gaps(df).filter(F.col("gap").isNotNull())
    group = F.create_map(*(F.lit(x) for f, names in SUBGROUP_NAMES.items() for x in (f, names[0])))
    yes = F.create_map(*(F.lit(x) for f, names in SUBGROUP_NAMES.items() for x in (f, names[1])))
    no = F.create_map(*(F.lit(x) for f, names in SUBGROUP_NAMES.items() for x in (f, names[2])))
    sides = F.array(
        F.struct(
            yes[F.col("flag")].alias("subgroup"),
            F.col("mean_true").alias("average_hours"),
            F.col("n_true").alias("n"),
        ),
        F.struct(
            no[F.col("flag")].alias("subgroup"),
            F.col("mean_false").alias("average_hours"),
            F.col("n_false").alias("n"),
        ),
    )
    return gaps.select(group[F.col("flag")].alias("group_name"), F.explode(sides).alias("s")).select(
        "group_name", "s.*"
    )


def target_attainment(df: DataFrame, target: float = DEFAULT_TARGET_HOURS) -> DataFrame:
    """A10 with A13: high-need and all tutored students at or above the target; NULL when nobody."""
    at_target, need = bands.hours(df) >= F.lit(float(target)), high_need(df)
    counts = tutored_students(df).agg(
        F.count_if(need & at_target).alias("need_at"),
        F.count_if(need).alias("need_n"),
        F.count_if(at_target).alias("all_at"),
        F.count(F.lit(1)).alias("all_n"),
    )
    need_n, all_n = F.nullif(F.col("need_n"), F.lit(0)), F.nullif(F.col("all_n"), F.lit(0))
    return counts.select(
        share(F.col("need_at"), need_n).alias("high_need_full_dosage_pct"),
        need_n.alias("high_need_n"),
        is_small_sample(need_n).alias("high_need_small_sample"),
        share(F.col("all_at"), all_n).alias("total_full_dosage_pct"),
        all_n.alias("total_n"),
    )


def ethnicity_dosage(df: DataFrame, target: float = DEFAULT_TARGET_HOURS) -> DataFrame:
    """Mean and median hours and share at target per ethnicity, tutored students."""
    h = tutored_students(df).select("ethnicity", bands.hours(df).alias("hours"))
    known, hours = h.filter(F.col("ethnicity").isNotNull()), F.col("hours")
    aggregates = {
        "avg_hours": F.avg(hours),
        "pct_full_dosage": share(F.count_if(hours >= F.lit(float(target))), F.count(hours)),
        "n": F.count(hours),
    }
    found = aggregate_with_quantiles(known, "hours", ["ethnicity"], aggregates, {"median_hours": 0.5})
    return found.select("ethnicity", "avg_hours", "median_hours", "pct_full_dosage", "n")


def performance_column(columns: list[str]) -> str | None:
    """P18."""
    candidates = ("performance_level_most_recent", "performance_level_current_year")
    return next((c for c in candidates if c in columns), None)


def outcome_columns(columns: list[str]) -> dict[str, str]:
    """Subject -> the column holding its current score."""
    found = {}
    for subject in SUBJECTS:
        candidates = (
            outcome_measures(subject)[-1],
            f"{subject}_latest_outcome",
            f"{subject}_state_score_current_year",
            f"{subject}_outcome_score_current_year",
        )
        column = next((c for c in candidates if c in columns), None)
        if column:
            found[subject] = column
    return found


def proficiency_summary(df: DataFrame, column: str | None = None) -> DataFrame:
    """Tutored and untutored students per proficiency level, all matched students."""
    column = column or performance_column(df.columns)
    if column is None or column not in df.columns:
        return literal_table(
            df.sparkSession,
            [],
            "level_rank int, proficiency_level string, tutored long, untutored long, total long, "
            "pct_tutored double",
        )
    got = bands.received_tutoring(df)
    return (
        df.filter(clean(column).isNotNull())
        .groupBy(strip(column).alias("proficiency_level"))
        .agg(
            F.count_if(got).alias("tutored"),
            F.count_if(~got).alias("untutored"),
            F.count(F.lit(1)).alias("total"),
        )
        .select(
            proficiency_rank(F.col("proficiency_level")).alias("level_rank"),
            "*",
            share(F.col("tutored"), F.col("total")).alias("pct_tutored"),
        )
        .orderBy("level_rank", F.lower("proficiency_level"))
    )


def proficiency_participation(df: DataFrame, column: str | None = None) -> DataFrame:
    """The same in long form, both statuses for every level, 0 where there is nobody."""
    summary = proficiency_summary(df, column)
    statuses = F.array(
        *(
            F.struct(
                F.lit(i).alias("status_ord"),
                F.lit(status).alias("tutoring_status"),
                F.col(status.lower()).alias("student_count"),
            )
            for i, status in enumerate(("Tutored", "Untutored"))
        )
    )
    return (
        summary.select("level_rank", "proficiency_level", "total", F.explode(statuses).alias("s"))
        .select(
            "level_rank",
            "proficiency_level",
            "s.status_ord",
            "s.tutoring_status",
            "s.student_count",
            F.col("total").alias("category_total"),
            share(F.col("s.student_count"), F.col("total")).alias("pct_of_category"),
        )
        .orderBy("level_rank", F.lower("proficiency_level"), "status_ord")
    )


def score_participation(df: DataFrame, smoothing_rows: int = SMOOTHING_ROWS) -> DataFrame:
    """A20 with W2: per subject and distinct current score, how many students were tutored, raw
    and smoothed over the neighbouring scores.  All matched students."""
    columns = outcome_columns(df.columns)
    if not columns:
        return literal_table(
            df.sparkSession,
            [],
            "subject string, outcome double, smoothed_pct_tutored double, pct_tutored double, "
            "student_count long, tutored_count long, untutored_count long, smoothing_students long, "
            "smoothing_window int",
        )
    scores = df.select(
        bands.received_tutoring(df).alias("got"),
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(subject.upper()).alias("subject"),
                        typed_number(c, df.schema[c].dataType).alias("outcome"),
                    )
                    for subject, c in columns.items()
                )
            )
        ).alias("s"),
    ).select("got", "s.*")
    per_score = value_counts(scores, "outcome", ["subject"], tutored=F.count_if(F.col("got")))
    rolled = centred_rolling_sums(
        per_score, "outcome", ["n", "tutored"], max(1, int(smoothing_rows)), ["subject"]
    )
    return rolled.select(
        "subject",
        "outcome",
        share(F.col("rolling_tutored"), F.col("rolling_n")).alias("smoothed_pct_tutored"),
        share(F.col("tutored"), F.col("n")).alias("pct_tutored"),
        F.col("n").alias("student_count"),
        F.col("tutored").alias("tutored_count"),
        (F.col("n") - F.col("tutored")).alias("untutored_count"),
        F.col("rolling_n").alias("smoothing_students"),
        F.col("window_rows").alias("smoothing_window"),
    ).orderBy("subject", "outcome")
