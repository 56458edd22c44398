"""Dosage: how many hours, how unequally, by school, subject, hour and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorspark.functions import bands, parsing
from tutorspark.functions.bands import DEFAULT_TARGET_HOURS, DOSAGE_SHARES, dosage_band_conditions
from tutorspark.functions.stats import share
from tutorspark.functions.text import percent_text, to_tenths
from tutorspark.operators.filters import tutored_students
from tutorspark.operators.prepare import duration_minutes, roster_with_subject_hours
from tutorspark.operators.ranking import aggregate_with_quantiles, gini, ranked_values
from tutorspark.schema import SUBJECTS

DOSAGE_BINS = 30
ROLLING_ROWS = 7


def band_shares(h: Column, among: Column, target: float) -> dict[str, Column]:
    """A5 as aggregates: percentage of the ``among`` rows in each left-closed band."""
    return {
        name: share(F.count_if(among & condition), F.count_if(among))
        for name, condition in dosage_band_conditions(h, target).items()
    }


def tutored_hours(df: DataFrame) -> DataFrame:
    return df.select(bands.hours(df).alias("hours")).filter("hours > 0")


def hours_ranking(df: DataFrame) -> DataFrame:
    """W3 over the hours of tutored students."""
    return ranked_values(tutored_hours(df), "hours")


def dosage_metrics(df: DataFrame, target: float = DEFAULT_TARGET_HOURS) -> DataFrame:
    """A4 with A5 and A6: one row, all NULL when nobody was tutored."""
    hours, h = tutored_hours(df), F.col("hours")
    aggregates = {
        "mean_hours": F.avg(h),
        "tutored_students": F.nullif(F.count(h), F.lit(0)),
        "total_tutoring_hours": F.sum(h),
        **band_shares(h, F.lit(True), target),
    }
    quartiles = {"q25": 0.25, "median_hours": 0.5, "q75": 0.75}
    found = aggregate_with_quantiles(hours, "hours", (), aggregates, quartiles)
    return found.select(
        "median_hours",
        "mean_hours",
        "q25",
        "q75",
        F.expr("q75 - q25 AS iqr"),
        "tutored_students",
        F.expr(f"CASE WHEN tutored_students > 0 THEN {float(target)!r}D END AS target_dosage"),
        "total_tutoring_hours",
        *DOSAGE_SHARES,
        gini(hours, "hours").alias("gini"),
    )


def school_dosage(df: DataFrame, target: float = DEFAULT_TARGET_HOURS) -> DataFrame:
    """Per school name, band shares of its tutored students and how many were tutored."""
    h, tutored = bands.hours(df), bands.is_tutored(df)
    return (
        df.filter(F.col("school_name").isNotNull())
        .groupBy("school_name")
        .agg(
            *(F.coalesce(c, F.lit(0.0)).alias(n) for n, c in band_shares(h, tutored, target).items()),
            F.count(F.lit(1)).alias("total_students"),
            F.count_if(tutored).alias("students_tutored"),
            share(F.count_if(tutored), F.count(F.lit(1))).alias("pct_tutored"),
        )
        .orderBy(F.desc("pct_full_dosage"), "school_name")
    )


def subject_dosage(
    df: DataFrame, sessions: DataFrame, target: float = DEFAULT_TARGET_HOURS
) -> DataFrame:
    """Per subject, the share of all matched students tutored in it and their band shares.

    A subject no session ever had is left out.
    """
    with_hours = roster_with_subject_hours(df, sessions)
    aggregates = [F.count(F.lit(1)).alias("total_students")]
    for s in SUBJECTS:
        in_subject = F.col(s) > 0
        aggregates += [
            F.coalesce(c, F.lit(0.0)).alias(f"{s}_{name}")
            for name, c in band_shares(F.col(s), in_subject, target).items()
        ]
        aggregates.append(F.count_if(in_subject).alias(f"{s}_tutored"))
    topic = F.lower("session_topic")
    taught = sessions.agg(
        F.struct(*(F.coalesce(F.max(topic == s), F.lit(False)).alias(s) for s in SUBJECTS)).alias("taught")
    ).scalar()
    rows = F.array(
        *(
            F.struct(
                F.lit(s.upper()).alias("subject"),
                *(F.col(f"{s}_{name}").alias(name) for name in DOSAGE_SHARES),
                F.col("total_students"),
                F.col(f"{s}_tutored").alias("students_tutored"),
                F.coalesce(share(F.col(f"{s}_tutored"), F.col("total_students")), F.lit(0.0)).alias(
                    "pct_tutored"
                ),
                taught[s].alias("taught"),
            )
            for s in SUBJECTS
        )
    )
    return (
        with_hours.agg(*aggregates)
        .select(F.explode(rows).alias("r"))
        .select("r.*")
        .filter("taught")
        .drop("taught")
        .orderBy(F.desc("pct_full_dosage"), "subject")
    )


def as_printed(table: DataFrame) -> DataFrame:
    """A7/A8 the way the report prints them: shares with one decimal, counts with their share."""
    printed = {name: percent_text(F.col(name)) for name in DOSAGE_SHARES}
    tutored = F.format_string("%d (%.1f%%)", F.col("students_tutored"), to_tenths(F.col("pct_tutored")))
    return table.withColumns({**printed, "students_tutored": tutored}).drop("pct_tutored")


def session_time(sessions: DataFrame) -> Column:
    """Wall-clock time of a session: a typed ``session_ts`` if there is one, else the parsed date."""
    if "session_ts" in sessions.columns:
        return F.col("session_ts").cast("timestamp_ntz")
    if not isinstance(sessions.schema["session_date"].dataType, T.StringType):
        return F.col("session_date").cast("timestamp_ntz")
    return parsing.timestamp("session_date")


def timed_sessions(sessions: DataFrame) -> DataFrame:
    """sessions with a readable date, reduced to what the time views need."""
    return sessions.select(
        session_time(sessions).alias("session_ts"), duration_minutes(sessions).alias("minutes"), "student_id"
    ).filter(F.col("session_ts").isNotNull())


def hourly_sessions(sessions: DataFrame) -> DataFrame:
    """Per hour of day over all sessions, whatever the filters or the roster."""
    return (
        timed_sessions(sessions)
        .groupBy(F.hour("session_ts").alias("hour_of_day"))
        .agg(
            bands.summed_hours(F.col("minutes")).alias("total_hours"),
            F.count("student_id").alias("session_count"),
        )
        .orderBy("hour_of_day")
    )


def daily_sessions(sessions: DataFrame) -> DataFrame:
    """A26 with W1: per calendar day over all sessions, plus the mean of the last 7 days present.

    The window has no partition on purpose: its input is one row per calendar day.
    """
    per_day = (
        timed_sessions(sessions)
        .groupBy(F.to_date("session_ts").alias("session_day"))
        .agg(
            F.avg(bands.minutes_to_hours(F.col("minutes"))).alias("avg_duration"),
            bands.summed_hours(F.col("minutes")).alias("total_hours"),
            F.count("minutes").alias("session_count"),
            F.count_distinct("student_id").alias("unique_students"),
        )
    )
    last_rows = Window.orderBy("session_day").rowsBetween(-(ROLLING_ROWS - 1), 0)
    return per_day.withColumn("rolling_avg", F.avg("avg_duration").over(last_rows)).orderBy("session_day")


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Add ``bin`` (1..bins) and its edges, given columns ``low`` and ``high`` with the extremes.

    NULL values are dropped; if all values are equal they are one bin.
    """
    bucket = f"""CASE WHEN low = high THEN 1
                 ELSE int(least(width_bucket({value}, low, high, {bins}), {bins})) END"""
    width = f"(high - low) / {bins}D"
    return (
        df.filter(F.col(value).isNotNull())
        .selectExpr("*", f"{bucket} AS bin")
        .selectExpr("*", f"low + {width} * (bin - 1) AS bin_low", f"low + {width} * bin AS bin_high")
    )


def dosage_histogram(
    df: DataFrame, target: float = DEFAULT_TARGET_HOURS, bins: int = DOSAGE_BINS
) -> DataFrame:
    """Tutored students per hours bin and right-closed dosage category."""
    h = tutored_students(df).select(bands.hours(df).alias("hours"))
    extremes = h.agg(F.expr("struct(min(hours) AS low, max(hours) AS high)")).scalar()
    return (
        equal_width_bins(h.select("hours", extremes.alias("x")).select("hours", "x.*"), "hours", bins)
        .groupBy("bin", "bin_low", "bin_high", bands.dosage_category(F.col("hours"), target).alias("category"))
        .agg(F.count(F.lit(1)).alias("students"))
        .orderBy("bin", "bin_low", "category")
    )
