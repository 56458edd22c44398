"""Headline numbers and the numeric summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorspark.functions import bands
from tutorspark.operators.dosage import session_time
from tutorspark.operators.prepare import duration_minutes
from tutorspark.operators.ranking import aggregate_with_quantiles

PREVIEW_ROWS = 10


def _distinct(df: DataFrame, name: str) -> Column:
    return F.count_distinct(name) if name in df.columns else F.lit(None).cast("long")


def overview_kpis(df: DataFrame) -> DataFrame:
    """Tutored students, their hours, schools served, and the size of the roster."""
    h, tutored = bands.hours(df), bands.is_tutored(df)
    school = F.col("school_name") if "school_name" in df.columns else F.lit(None).cast("string")
    return df.agg(
        F.count_if(tutored).alias("tutored_students"),
        F.coalesce(F.sum(F.when(tutored, h)), F.lit(0.0)).alias("total_hours"),
        F.coalesce(F.avg(F.when(tutored, h)), F.lit(0.0)).alias("avg_hours"),
        F.count_distinct(F.when(tutored, school)).alias("schools_served"),
        F.count(F.lit(1)).alias("roster_students"),
    )


def session_kpis(sessions: DataFrame) -> DataFrame:
    """A23; date range over readable dates, mean over readable durations."""
    columns = sessions.columns
    dated = "session_ts" in columns or "session_date" in columns
    when = session_time(sessions) if dated else F.lit(None).cast("timestamp_ntz")
    minutes = duration_minutes(sessions) if "session_duration" in columns else F.lit(None).cast("double")

    def topic_count(topic: str) -> Column:
        if "session_topic" not in columns:
            return F.lit(None).cast("long")
        return F.count_if(F.lower("session_topic") == topic)

    return sessions.agg(
        F.count(F.lit(1)).alias("total_sessions"),
        topic_count("math").alias("math_sessions"),
        topic_count("ela").alias("ela_sessions"),
        _distinct(sessions, "tutor_id").alias("unique_tutors"),
        F.to_date(F.min(when)).cast("string").alias("first_date"),
        F.to_date(F.max(when)).cast("string").alias("last_date"),
        F.avg(minutes).alias("avg_minutes"),
    )


def roster_kpis(prepared: DataFrame) -> DataFrame:
    """A24; districts by name, else by id.

    Students are first counted per (school, district, grade), so that the three distinct counts
    expand that short table and not the roster.
    """
    district = "district_name" if "district_name" in prepared.columns else "district_id"
    keys = [c for c in ("school_name", district, "current_grade_level") if c in prepared.columns]
    cells = prepared.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(bands.is_tutored(prepared)).alias("_t")
    )
    return cells.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_students"),
        F.coalesce(F.sum("_t"), F.lit(0)).alias("tutored_students"),
        _distinct(cells, "school_name").alias("schools"),
        _distinct(cells, district).alias("districts"),
        _distinct(cells, "current_grade_level").alias("grade_levels"),
    )


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by student id."""
    return df.orderBy(F.col("student_id").asc_nulls_last()).limit(rows)


def numeric_summary(df: DataFrame) -> DataFrame:
    """Count, mean, sd, min, exact quartiles and max of every numeric column.

    Tutored rows, or all rows when nobody was tutored.  All columns are ranked together in one
    pass; a column without any value has no row.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    anyone = df.agg(F.coalesce(F.max(bands.is_tutored(df)), F.lit(False))).scalar()
    cells = F.array(
        *(
            F.struct(F.lit(name).alias("column"), F.col(name).cast("double").alias("value"))
            for name in numeric
        )
    )
    values = (
        df.filter(bands.is_tutored(df) | ~anyone)
        .select(F.explode(cells).alias("c"))
        .select("c.*")
        .filter(F.col("value").isNotNull())
    )
    v, quartiles = F.col("value"), {"q25": 0.25, "median": 0.5, "q75": 0.75}
    aggregates = {"n": F.count(v), "mean": F.avg(v), "sd": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    found = aggregate_with_quantiles(values, "value", ["column"], aggregates, quartiles)
    return found.select("column", "n", "mean", "sd", "min", *quartiles, "max")
