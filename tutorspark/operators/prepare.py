"""The core query: sessions rolled up to hours per student, joined to the roster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.functions.bands import minutes_to_hours, summed_hours
from tutorspark.functions.parsing import typed_number
from tutorspark.functions.text import strip
from tutorspark.operators.joins import join_per_key
from tutorspark.schema import SUBJECTS, outcome_measures


def duration_minutes(sessions: DataFrame) -> Column:
    """Session length as a finite double, NULL when it cannot be read."""
    return typed_number("session_duration", sessions.schema["session_duration"].dataType)


def duration_hours(sessions: DataFrame) -> Column:
    """P13 on a session table."""
    return minutes_to_hours(duration_minutes(sessions))


def with_trimmed_id(df: DataFrame) -> DataFrame:
    return df.withColumn("student_id", strip("student_id"))


def identified_sessions(sessions: DataFrame, *columns: Column) -> DataFrame:
    """Sessions with an id, reduced to the trimmed id and ``columns``.

    The NULL test is on the stored column, where Parquet statistics can answer it, and the trimmed
    id is declared non-null, so that no join above adds a second trim per row to test it again.
    """
    return sessions.filter("student_id IS NOT NULL").select(
        F.coalesce(strip("student_id"), F.lit("")).alias("student_id"), *columns
    )


def hours_per_student(sessions: DataFrame) -> DataFrame:
    """A1: (student_id, total_hours) over all sessions with an id.

    Sum per map task first, so a student with very many sessions is no hot key.  There is no
    semi-join with the roster in front: it would shuffle every session row only to drop ids that
    the left join from the roster drops anyway, after the roll-up and at one row each.
    """
    return (
        identified_sessions(sessions, duration_minutes(sessions).alias("minutes"))
        .groupBy("student_id")
        .agg(summed_hours(F.col("minutes")).alias("total_hours"))
    )


def hours_per_student_topic(sessions: DataFrame) -> DataFrame:
    """A2: (student_id, session_topic, subject_hours), all sessions."""
    return (
        identified_sessions(
            sessions.filter("session_topic IS NOT NULL"),
            F.col("session_topic"),
            duration_minutes(sessions).alias("minutes"),
        )
        .groupBy("student_id", "session_topic")
        .agg(summed_hours(F.col("minutes")).alias("subject_hours"))
    )


def hours_by_subject(sessions: DataFrame) -> DataFrame:
    """A3: one row per student with a column of hours per subject, 0 where there are none.

    Conditional sums in one aggregation: the same result as a pivot of A2 without its second
    shuffle.
    """
    return (
        identified_sessions(
            sessions.filter("session_topic IS NOT NULL"),
            F.lower("session_topic").alias("topic"),
            duration_minutes(sessions).alias("minutes"),
        )
        .groupBy("student_id")
        .agg(*(summed_hours(F.when(F.col("topic") == s, F.col("minutes"))).alias(s) for s in SUBJECTS))
    )


def roster_with_hours(roster: DataFrame, hours: DataFrame) -> DataFrame:
    """Every roster row once; unmatched or missing id means 0 hours."""
    joined = join_per_key(roster, hours, "student_id", "left")
    return joined.withColumn("total_hours", F.expr("coalesce(total_hours, 0.0D)"))


def latest_outcome(df: DataFrame, subject: str) -> Column:
    """The ready-made column, else the newest non-null measure present."""
    name = f"{subject}_latest_outcome"
    if name in df.columns:
        return typed_number(name, df.schema[name].dataType)
    newest_first = [m for m in reversed(outcome_measures(subject)) if m in df.columns]
    if not newest_first:
        return F.expr("double(NULL)")
    return F.coalesce(*(typed_number(m, df.schema[m].dataType) for m in newest_first))


def with_outcome_columns(df: DataFrame) -> DataFrame:
    """Latest outcome, raw gain and value added per subject."""
    base = df.drop(*(c for s in SUBJECTS if (c := f"{s}_latest_outcome") in df.columns))
    derived: dict[str, Column] = {}
    for subject in SUBJECTS:
        measures = outcome_measures(subject)
        derived[f"{subject}_latest_outcome"] = latest_outcome(base, subject)
        if all(m in df.columns for m in measures):
            first, second, third = measures
            derived[f"{subject}_raw_gain"] = F.expr(f"{third} - {first}")
            derived[f"{subject}_value_added"] = F.expr(f"({third} - {second}) - ({second} - {first})")
        else:
            derived[f"{subject}_raw_gain"] = F.expr("double(NULL)")
            derived[f"{subject}_value_added"] = F.expr("double(NULL)")
    return df.withColumns(derived)


def prepare(sessions: DataFrame, roster: DataFrame) -> DataFrame:
    """Roster rows with ``total_hours``, ``received_tutoring`` and outcome columns.

    Without a roster id the roster comes back unchanged; without session id or duration everyone
    has 0 hours.
    """
    if "student_id" not in roster.columns:
        return roster
    students = with_trimmed_id(roster)
    if "total_hours" in roster.columns:
        students = students.drop("total_hours")
    if {"student_id", "session_duration"} <= set(sessions.columns):
        with_hours = roster_with_hours(students, hours_per_student(sessions))
    else:
        with_hours = students.withColumn("total_hours", F.lit(0.0))
    return with_outcome_columns(with_hours.withColumn("received_tutoring", F.expr("total_hours > 0")))


def roster_with_subject_hours(prepared: DataFrame, sessions: DataFrame) -> DataFrame:
    """Prepared (filtered) rows with hours per subject."""
    joined = join_per_key(prepared.drop(*SUBJECTS), hours_by_subject(sessions), "student_id", "left")
    return joined.fillna(0.0, list(SUBJECTS))
