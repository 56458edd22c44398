"""Outcomes: value added and raw gain of tutored students."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorspark.functions.stats import MARGINAL, SIGNIFICANT, WEEKS_PER_SD, share, t_test_p_value
from tutorspark.operators.dosage import equal_width_bins
from tutorspark.operators.filters import tutored_students
from tutorspark.operators.ranking import aggregate_with_quantiles
from tutorspark.schema import SUBJECTS
from tutorspark.sources.literals import literal_table

MEASURES = ("value_added", "raw_gain")
HISTOGRAM_BINS = 20


def measure_rows(df: DataFrame) -> DataFrame:
    """(subject, measure, value) of tutored students, in one pass for all four columns."""
    entries = [
        F.struct(
            F.lit(s).alias("subject"),
            F.lit(m).alias("measure"),
            F.col(f"{s}_{m}").cast("double").alias("value"),
        )
        for s in SUBJECTS
        for m in MEASURES
        if f"{s}_{m}" in df.columns
    ]
    if not entries:
        entries = [F.lit(None).cast("struct<subject: string, measure: string, value: double>")]
    return (
        tutored_students(df)
        .select(F.explode(F.array(*entries)).alias("m"))
        .select("m.*")
        .filter(F.col("value").isNotNull())
    )


def outcome_metrics(df: DataFrame) -> DataFrame:
    """A14 with A15: one row per subject and measure that has any value.

    Median, p-value and significance are value-added metrics only.  Effect size is mean over
    standard deviation and absent when that is zero or unknown.
    """
    values, v = measure_rows(df), F.col("value")
    aggregates = {
        "mean": F.avg(v),
        "sd": F.stddev_samp(v),
        "positive_pct": share(F.count_if(v > 0), F.count(v)),
        "n": F.count(v),
    }
    moments = aggregate_with_quantiles(values, "value", ["subject", "measure"], aggregates, {"median": 0.5})
    moments = moments.select("subject", "measure", "mean", "median", "sd", "positive_pct", "n")
    value_added = F.col("measure") == "value_added"
    return (
        moments.withColumn("effect_size", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")))
        .withColumn("weeks_learning", F.col("effect_size") * F.lit(WEEKS_PER_SD))
        .withColumn(
            "p_value",
            F.when(value_added, t_test_p_value(F.col("mean"), F.col("sd"), F.col("n"))),
        )
        .withColumn(
            "significant",
            F.when(value_added & (F.col("n") > 1), F.coalesce(F.col("p_value") < SIGNIFICANT, F.lit(False))),
        )
        .withColumn("median", F.when(value_added, F.col("median")))
    )


def wide_outcome_metrics(metrics: DataFrame) -> DataFrame:
    """A14 as one row with columns such as ela_va_mean; NULL where a metric does not exist."""
    prefixes = {"value_added": "va", "raw_gain": "raw"}
    names = {
        "value_added": {
            "mean": "mean",
            "median": "median",
            "sd": "std",
            "positive_pct": "positive_pct",
            "n": "n",
            "p_value": "pvalue",
            "significant": "significant",
            "effect_size": "effect_size",
            "weeks_learning": "weeks_learning",
        },
        "raw_gain": {
            "mean": "mean",
            "positive_pct": "positive_pct",
            "n": "n",
            "effect_size": "effect_size",
            "weeks_learning": "weeks_learning",
        },
    }
    cells = []
    for s in SUBJECTS:
        for m, columns in names.items():
            here = (F.col("subject") == s) & (F.col("measure") == m)
            cells += [
                F.max(F.when(here, F.col(source))).alias(f"{s}_{prefixes[m]}_{target}")
                for source, target in columns.items()
            ]
    return metrics.agg(*cells)


def weighted_average(value: str, weight: str = "n") -> Column:
    """A16 as an aggregate: weighted mean over rows with a value and a positive weight, else NULL."""
    usable = F.col(value).isNotNull() & (F.col(weight) > 0)
    total = F.sum(F.when(usable, F.col(value) * F.col(weight)))
    return F.try_divide(total, F.sum(F.when(usable, F.col(weight))).cast("double"))


def overall_outcomes(metrics: DataFrame) -> DataFrame:
    """A16 for mean value added, effect size and weeks, weighted by students per subject."""
    names = {"mean": "avg_value_added", "effect_size": "avg_effect_size", "weeks_learning": "avg_weeks"}
    va = metrics.filter(F.col("measure") == "value_added")
    return va.agg(*(weighted_average(value).alias(name) for value, name in names.items()))


def outcome_labels(metrics: DataFrame) -> DataFrame:
    """Per subject, significance and direction of the value added; a missing mean counts as 0."""
    subjects = literal_table(metrics.sparkSession, [(s,) for s in SUBJECTS], "subject string")
    va = metrics.filter(F.col("measure") == "value_added").select("subject", "mean", "p_value")
    return subjects.join(va, "subject", "left").select(
        "subject",
        F.when(F.col("p_value") < SIGNIFICANT, "significant")
        .when(F.col("p_value") < MARGINAL, "marginal")
        .alias("significance"),
        F.when(F.coalesce("mean", F.lit(0.0)) < 1, "limited")
        .otherwise("directionally positive")
        .alias("direction"),
    )


def outcome_histogram(df: DataFrame, subject: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Tutored students per equal-width bin of value added and raw gain, with the mean.

    Extremes and means of both measures are one aggregation, the binning of both is another.
    """
    measures = [m for m in MEASURES if f"{subject}_{m}" in df.columns]
    if not measures:
        return literal_table(
            df.sparkSession,
            [],
            "subject string, measure string, bin int, bin_low double, bin_high double, mean double, students long",
        )
    wide = tutored_students(df).selectExpr(*(f"double({subject}_{m}) AS {m}" for m in measures))
    limits = wide.agg(
        F.struct(
            *(F.expr(f"struct(min({m}) AS low, max({m}) AS high, avg({m}) AS mean)").alias(m) for m in measures)
        )
    ).scalar()
    cells = ", ".join(
        f"struct('{m}' AS measure, {m} AS value, x.{m}.low AS low, x.{m}.high AS high, x.{m}.mean AS mean)"
        for m in measures
    )
    long = wide.select("*", limits.alias("x")).selectExpr(f"inline(array({cells}))")
    return (
        equal_width_bins(long, "value", bins)
        .groupBy(F.lit(subject).alias("subject"), "measure", "bin", "bin_low", "bin_high", "mean")
        .agg(F.count(F.lit(1)).alias("students"))
        .orderBy("measure", "bin")
    )
