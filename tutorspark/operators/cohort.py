"""Cohort report: who is in the programme, how they compare, and how sessions are made up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.functions import bands
from tutorspark.functions.bands import ROSTER_GRADE_BANDS, TOPIC_GRADE_BANDS, flag_is, grade_band, grade_band_label
from tutorspark.functions.stats import share
from tutorspark.operators.dosage import session_time
from tutorspark.operators.joins import grade_by_student
from tutorspark.operators.prepare import duration_minutes, identified_sessions
from tutorspark.operators.ranking import (
    aggregate_with_quantiles,
    smallest_rows,
)
from tutorspark.schema import COHORT_FLAGS, EQUITY_FLAGS
from tutorspark.sources.literals import literal_table

MINIMUM_WEIGHT = 1e-9


def _treated_hours(df: DataFrame) -> Column:
    return F.when(bands.received_tutoring(df), bands.hours(df))


def flag_rates(df: DataFrame) -> DataFrame:
    """Share TRUE of all rows, per flag present."""
    flags = [f for f in COHORT_FLAGS if f in df.columns]
    if not flags:
        return literal_table(df.sparkSession, [], "flag string, pct_true double")
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"), *(F.count_if(flag_is(df, f, True)).alias(f) for f in flags)
    )
    rows = F.array(
        *(F.struct(F.lit(f).alias("flag"), share(F.col(f), F.col("_n")).alias("pct_true")) for f in flags)
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def flag_enrolment(df: DataFrame) -> DataFrame:
    """Share treated among flag TRUE; flags without a TRUE row are left out."""
    flags = [f for f in COHORT_FLAGS if f in df.columns]
    if not flags:
        return literal_table(df.sparkSession, [], "flag string, n long, pct_treated double")
    got = bands.received_tutoring(df)
    counts = df.agg(
        *(F.count_if(flag_is(df, f, True)).alias(f"{f}_n") for f in flags),
        *(F.count_if(flag_is(df, f, True) & got).alias(f"{f}_t") for f in flags),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(f).alias("flag"),
                F.col(f"{f}_n").alias("n"),
                share(F.col(f"{f}_t"), F.col(f"{f}_n")).alias("pct_treated"),
            )
            for f in flags
        )
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*").filter("n > 0")


def prior_score(df: DataFrame) -> Column:
    return (F.col("ela_outcome_measure_2") + F.col("math_outcome_measure_2")) / F.lit(2.0)


def enrolment_by_prior_score(df: DataFrame) -> DataFrame:
    """Share treated per right-closed bin of the mean middle score."""
    got = bands.received_tutoring(df)
    return (
        df.groupBy(bands.score_bin(prior_score(df)).alias("score_bin"))
        .agg(share(F.count_if(got), F.count(F.lit(1))).alias("pct_treated"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("score_bin").isNotNull())
    )


def grade_band_shares(
    df: DataFrame, grade_bands: Sequence[tuple[int, int]] = ROSTER_GRADE_BANDS
) -> DataFrame:
    """Share of all rows per inclusive grade band, 0 included; bands may overlap."""
    grade = F.col("current_grade_level")
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.count_if(grade.between(low, high)).alias(f"_b{i}") for i, (low, high) in enumerate(grade_bands)),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(grade_band_label(low, high)).alias("grade_band"),
                F.col(f"_b{i}").alias("n"),
                share(F.col(f"_b{i}"), F.col("_n")).alias("pct"),
            )
            for i, (low, high) in enumerate(grade_bands)
        )
    )
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def dosage_moments(df: DataFrame) -> DataFrame:
    """Median, mean, sd, min and max of treated hours."""
    treated = df.select(_treated_hours(df).alias("hours"))
    h = F.col("hours")
    known = treated.filter(h.isNotNull())
    aggregates = {"mean_hours": F.avg(h), "sd_hours": F.stddev_samp(h), "min_hours": F.min(h), "max_hours": F.max(h)}
    return aggregate_with_quantiles(known, "hours", (), aggregates, {"median_hours": 0.5}).select("median_hours", *aggregates)


def flag_dosage(df: DataFrame) -> DataFrame:
    """Mean treated hours for flag TRUE against the rest, where unknown is part of the rest."""
    flags = [f for f in EQUITY_FLAGS if f in df.columns]
    if not flags:
        return literal_table(df.sparkSession, [], "flag string, mean_flag double, mean_rest double")
    h = _treated_hours(df)
    means = df.agg(
        *(F.avg(F.when(flag_is(df, f, True), h)).alias(f"{f}_yes") for f in flags),
        *(F.avg(F.when(~flag_is(df, f, True), h)).alias(f"{f}_rest") for f in flags),
    )
    rows = F.array(
        *(
            F.struct(
                F.lit(f).alias("flag"),
                F.col(f"{f}_yes").alias("mean_flag"),
                F.col(f"{f}_rest").alias("mean_rest"),
            )
            for f in flags
        )
    )
    return (
        means.select(F.explode(rows).alias("r"))
        .select("r.*")
        .filter(F.col("mean_flag").isNotNull() & F.col("mean_rest").isNotNull())
    )


def treatment_effect(df: DataFrame, before: str = "ela_outcome_measure_2", after: str = "ela_outcome_measure_3") -> DataFrame:
    """Growth of treated and control rows and their standardised difference."""
    growth, got = F.col(after) - F.col(before), bands.received_tutoring(df)
    moments = df.agg(
        F.avg(F.when(got, growth)).alias("treated_mean"),
        F.stddev_samp(F.when(got, growth)).alias("treated_sd"),
        F.avg(F.when(~got, growth)).alias("control_mean"),
        F.stddev_samp(F.when(~got, growth)).alias("control_sd"),
    )
    pooled = F.sqrt(
        (F.col("treated_sd") * F.col("treated_sd") + F.col("control_sd") * F.col("control_sd")) / F.lit(2.0)
    )
    return moments.withColumn(
        "effect_size", F.try_divide(F.col("treated_mean") - F.col("control_mean"), pooled)
    )


def score_correlation(df: DataFrame, x: str = "ela_outcome_measure_2", y: str = "math_outcome_measure_2") -> DataFrame:
    """Pearson correlation over rows with both values; NULL when one of them never varies."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(
        F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)).alias("correlation")
    )


def sessions_per_treated(sessions: DataFrame, prepared: DataFrame) -> DataFrame:
    """A39."""
    treated = prepared.agg(F.count_if(bands.received_tutoring(prepared))).scalar()
    return sessions.agg(F.count(F.lit(1)).alias("total_sessions"), treated.alias("treated_students")).withColumn(
        "sessions_per_student", F.try_divide(F.col("total_sessions").cast("double"), F.col("treated_students"))
    )


def ratio_shares(sessions: DataFrame) -> DataFrame:
    """Share of sessions per student-to-tutor ratio.

    The total is taken from the counts, so the sessions are read once.
    """
    known = sessions.filter(F.col("session_ratio").isNotNull())
    counts = known.groupBy("session_ratio").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", share(F.col("n"), counts.agg(F.sum("n")).scalar()))


def topic_share_by_grade_band(
    sessions: DataFrame, roster: DataFrame, grade_bands: Sequence[tuple[int, int]] = TOPIC_GRADE_BANDS
) -> DataFrame:
    """Share of math sessions per grade band.

    Sessions are counted per student before they meet the roster, so the join sees one row per
    student on either side, both already partitioned by the id.
    """
    per_student = (
        identified_sessions(sessions, F.col("session_topic"))
        .groupBy("student_id")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.count_if(F.col("session_topic") == "math").alias("math_sessions"),
        )
    )
    graded = per_student.join(grade_by_student(roster), "student_id").withColumn(
        "grade_band", grade_band(F.col("current_grade_level"), grade_bands)
    )
    pct_math = share(F.sum("math_sessions"), F.sum("sessions"))
    return (
        graded.filter(F.col("grade_band").isNotNull())
        .groupBy("grade_band")
        .agg(F.sum("sessions").alias("sessions"), pct_math.alias("pct_math"))
        .withColumn("pct_other", F.lit(100.0) - F.col("pct_math"))
    )


def session_time_profile(sessions: DataFrame) -> DataFrame:
    """First, last and most common hour (the earliest of equals) and weekend sessions."""
    per_hour = (
        sessions.select(session_time(sessions).alias("ts"))
        .filter(F.col("ts").isNotNull())
        .groupBy(F.hour("ts").alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.weekday("ts") >= 5).alias("weekend"))
    )
    return per_hour.agg(
        F.min("hour").alias("first_hour"),
        F.max("hour").alias("last_hour"),
        F.max(F.struct(F.col("n"), (-F.col("hour")).alias("h")))["h"].alias("_h"),
        F.sum("weekend").alias("weekend_sessions"),
    ).select("first_hour", "last_hour", (-F.col("_h")).alias("most_common_hour"), "weekend_sessions")


def within_student_spread(sessions: DataFrame) -> DataFrame:
    """Mean over students of the sd of their session minutes, single sessions ignored."""
    per_student = (
        sessions.filter(F.col("student_id").isNotNull())
        .groupBy("student_id")
        .agg(F.stddev_samp(duration_minutes(sessions)).alias("sd"))
    )
    return per_student.agg(F.avg("sd").alias("mean_within_student_sd"), F.count("sd").alias("students"))


ROWS_PER_RUN = 10_000


def numbered_copies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of ``df`` with ``_copy``, its number among the rows that are equal in all columns, and
    ``_key``, a digest of the key columns and that number that no other row of equal keys has.

    Equal rows are counted, partly before the shuffle, and written out again in runs, so neither a
    retry nor another partitioning changes the digests.  Runs are dealt to all tasks before they are written out, so
    a row that is repeated very often is the work of many.  Columns must be comparable.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    runs = counts.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / ROWS_PER_RUN))))
    # With their number given, tasks are not merged for the few bytes that runs have.
    runs = runs.repartition(tasks, *df.columns, "_run")
    first = F.col("_run") * ROWS_PER_RUN
    copies = F.sequence(first, F.least(first + ROWS_PER_RUN, F.col("_copies")) - 1)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in keys]
    digest = F.md5(F.concat_ws("|", *parts, F.col("_copy").cast("string")))
    return runs.withColumn("_copy", F.explode(copies)).withColumn("_key", digest).drop("_copies", "_run")


def uniform(key: str, seed: int) -> Column:
    """A number in (0, 1] from a row's key: the same row draws the same number on every attempt."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    return F.lit(1.0) - F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def weighted_sample(
    df: DataFrame, weight: Column, k: int | None, seed: int = 42, keys: Sequence[str] | None = None
) -> DataFrame:
    """Exactly k rows without replacement, chance by weight; without k each row on its own.

    Every row draws an exponential waiting time -ln(u)/weight, and the k shortest win.  Weights are
    floored at 1e-9; if none is positive, or any is not finite, all rows weigh the same.  The draw
    depends on the seed, on the key columns (all, if none are named) and on a row's number among its
    equals: repeated and missing ids draw for each row, and neither a lost executor nor another
    partitioning changes the sample.  Rows that share their keys must be equal throughout.
    """
    keys = list(df.columns if keys is None else keys)
    drawn = numbered_copies(df.withColumn("_w", weight.cast("double")), keys).withColumn("_u", uniform("_key", seed))
    if k is None:
        return drawn.filter(F.lit(1.0) - F.col("_u") < F.col("_w")).select(*df.columns)
    if k <= 0:
        return df.limit(0)
    finite = F.col("_w").isNotNull() & (F.abs("_w") < F.lit(float("inf")))
    positive = F.greatest("_w", F.lit(0.0))
    usable = drawn.agg(
        F.coalesce(F.min(finite), F.lit(False)) & (F.coalesce(F.max(positive), F.lit(0.0)) > 0)
    ).scalar()
    effective = F.when(usable, F.greatest("_w", F.lit(MINIMUM_WEIGHT))).otherwise(F.lit(1.0))
    waiting = drawn.withColumn("_wait", -F.log("_u") / effective)
    return smallest_rows(waiting, "_wait", [*keys, "_copy"], k).select(*df.columns)
