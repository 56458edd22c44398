"""Cost: what an hour, a student and a point of growth cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.functions import bands
from tutorspark.functions.bands import DEFAULT_TARGET_HOURS
from tutorspark.operators.filters import tutored_students
from tutorspark.schema import SUBJECTS


def _points(df: DataFrame, measure: str) -> Column:
    """Sum over both subjects, losses included; an absent column adds nothing."""
    total = F.lit(0.0)
    for s in SUBJECTS:
        if f"{s}_{measure}" in df.columns:
            total = total + F.coalesce(F.sum(F.col(f"{s}_{measure}").cast("double")), F.lit(0.0))
    return total


def cost_metrics(
    df: DataFrame,
    total_cost: float,
    target: float = DEFAULT_TARGET_HOURS,
    reference: DataFrame | None = None,
) -> DataFrame:
    """One row.  The total cost is shared out by hours in view over hours in ``reference``.

    Everything is NULL when nobody in view was tutored.  Cost per point is NULL unless the points
    add up to more than zero.
    """
    reference = df if reference is None else reference
    reference_hours = (
        tutored_students(reference).agg(F.coalesce(F.sum(bands.hours(reference)), F.lit(0.0))).scalar()
    )
    h = bands.hours(df)
    view = tutored_students(df).agg(
        F.nullif(F.count(F.lit(1)), F.lit(0)).alias("tutored_students"),
        F.count_if(h >= F.lit(float(target))).alias("at_target"),
        F.sum(h).alias("hours"),
        _points(df, "value_added").alias("va_points"),
        _points(df, "raw_gain").alias("raw_points"),
        reference_hours.alias("reference_hours"),
    )
    anyone = F.col("tutored_students").isNotNull()
    in_proportion = (F.col("reference_hours") > 0) & (F.col("hours") > 0)
    hours_share = F.try_divide("hours", "reference_hours")
    allocated = F.lit(float(total_cost)) * F.when(in_proportion, hours_share).otherwise(F.lit(1.0))
    costed = view.withColumn("allocated_cost", F.when(anyone, allocated))

    def per(points: str) -> Column:
        return F.when(F.col(points) > 0, F.col("allocated_cost") / F.col(points))

    return costed.select(
        "allocated_cost",
        "tutored_students",
        F.when(anyone, F.col("at_target")).alias("students_at_target_dosage"),
        F.col("hours").alias("total_tutoring_hours"),
        F.when(anyone & (F.col("reference_hours") > 0), hours_share).alias("cost_allocation_share"),
        F.try_divide("allocated_cost", "tutored_students").alias("cost_per_student"),
        F.try_divide("allocated_cost", "hours").alias("cost_per_hour"),
        per("va_points").alias("cost_per_va_point"),
        per("raw_points").alias("cost_per_raw_point"),
    )
