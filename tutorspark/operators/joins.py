"""Joins between the roster, the session log and per-student tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorspark.functions.bands import grade_band, received_tutoring

_SPREAD = "_spread"


def join_per_key(left: DataFrame, per_key: DataFrame, key: str, how: str) -> DataFrame:
    """Join many rows (``left``) with at most one row per text key (``per_key``).

    A key holding a large share of ``left``, or NULL in that many rows, must not end up in one
    task.  AQE splits such a partition, but only when both join inputs come straight from a
    shuffle.  ``per_key`` is an aggregate already partitioned by ``key`` alone and would be joined
    in place; joining on a second column that follows from the key makes Spark shuffle both sides
    for the join itself.  The price is one more shuffle of the per-key rows.
    """
    second = f"coalesce(length({key}), 0) AS {_SPREAD}"
    joined = left.selectExpr("*", second).join(per_key.selectExpr("*", second), [key, _SPREAD], how)
    if left.columns[0] == key:
        return joined.drop(_SPREAD)
    added = [] if how == "left_semi" else [c for c in per_key.columns if c != key]
    return joined.select(*left.columns, *added)


def known_ids(df: DataFrame) -> DataFrame:
    """Distinct non-null student ids."""
    return df.filter(F.col("student_id").isNotNull()).select("student_id").distinct()


def sessions_on_roster(sessions: DataFrame, roster: DataFrame) -> DataFrame:
    """Sessions whose student is on the roster; a crowded student's sessions are split by AQE alone."""
    return join_per_key(sessions, known_ids(roster), "student_id", "left_semi")


def treated(df: DataFrame) -> DataFrame:
    """J5, one side."""
    return df.filter(received_tutoring(df))


def control(df: DataFrame) -> DataFrame:
    """J5, the complement."""
    return df.filter(~received_tutoring(df))


def split_by_ids(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J5 for an explicit id table: members and the rest (rows without an id are in the rest)."""
    marked = join_per_key(df, known_ids(ids).withColumn("_member", F.lit(True)), "student_id", "left")
    member = F.col("_member").isNotNull()
    return marked.filter(member).drop("_member"), marked.filter(~member).drop("_member")


def grade_by_student(roster: DataFrame) -> DataFrame:
    """One grade per student id, the highest if an id is listed more than once."""
    return (
        roster.filter(F.col("student_id").isNotNull())
        .groupBy("student_id")
        .agg(F.max("current_grade_level").alias("current_grade_level"))
    )


def sessions_with_grade(sessions: DataFrame, roster: DataFrame) -> DataFrame:
    """Session rows with the student's grade, NULL when the student is not on the roster."""
    return join_per_key(sessions, grade_by_student(roster), "student_id", "left")


def with_grade_band(df: DataFrame, bands: Sequence[tuple[int, int]]) -> DataFrame:
    """Add ``grade_band``."""
    return df.withColumn("grade_band", grade_band(F.col("current_grade_level"), bands))
