"""Hours, dosage bands, score levels and weights as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorspark.functions.text import lowered

DEFAULT_TARGET_HOURS = 60.0
MILLION = 1e6
MOST_EXACT_MINUTES = 1e6

# Band edges as shares of the target, labels, and score cut-offs.
DOSAGE_EDGES = (0.25, 0.5, 0.75, 1.0)
DOSAGE_LABELS = ("<25%", "25-50%", "50-75%", "75-99%", "100%+")
DOSAGE_SHARES = ("pct_below_25", "pct_25_50", "pct_50_75", "pct_75_99", "pct_full_dosage")
LEVEL_CUTS = (680, 710, 740, 770, 790)
LEVEL_LABELS = ("Below Basic", "Basic", "Proficient", "Advanced", "Distinguished", "Exceeds")
SCORE_FLOOR, SCORE_CEILING = 0, 1000
TOPIC_GRADE_BANDS = ((-1, 3), (4, 5), (6, 8), (9, 12))
ROSTER_GRADE_BANDS = ((-1, 2), (3, 5), (6, 8), (9, 12))

# Phrases looked up inside a proficiency label, in rank order.
PROFICIENCY_PHRASES = (
    "far below basic",
    "below basic",
    "basic",
    "approaching",
    "proficient",
    "advanced",
    "exceeds",
    "level 1",
    "level 2",
    "level 3",
    "level 4",
    "level 5",
    "novice",
    "developing",
    "distinguished",
)


def minutes_to_hours(minutes: Column) -> Column:
    """P13."""
    return minutes / F.lit(60.0)


def summed_hours(minutes: Column) -> Column:
    """P13 as an aggregate: hours of all minutes, summed exactly and divided once; 0 without any.

    Minutes are summed as whole millionths, which come to the same in any order, so that sessions
    that add up to a band edge lie on it and a rerun cannot move a student across.  What is finer
    than a millionth, or a million minutes and more, is summed as it is; so is everything should the
    whole number not fit.
    """
    small = F.abs(minutes) < F.lit(MOST_EXACT_MINUTES)
    whole = F.when(small, F.rint(minutes * F.lit(MILLION))).cast("long")
    rest = minutes - F.coalesce(whole / F.lit(MILLION), F.lit(0.0))
    exact = F.try_sum(whole) / F.lit(MILLION) + F.sum(rest)
    total = F.when(F.count(whole) == 0, F.sum(minutes)).otherwise(F.coalesce(exact, F.sum(minutes)))
    return F.coalesce(minutes_to_hours(total), F.lit(0.0))


def hours(df: DataFrame) -> Column:
    """Total hours of a prepared row, 0 when missing."""
    if "total_hours" not in df.columns:
        return F.lit(0.0)
    return F.expr("coalesce(double(total_hours), 0.0D)")


def is_tutored(df: DataFrame) -> Column:
    """more than zero hours."""
    return hours(df) > 0


def received_tutoring(df: DataFrame) -> Column:
    """The flag column if there is one (boolean or text), else hours above zero."""
    if "received_tutoring" not in df.columns:
        return is_tutored(df)
    flag = F.col("received_tutoring")
    if isinstance(df.schema["received_tutoring"].dataType, T.BooleanType):
        return F.coalesce(flag, F.lit(False))
    return F.coalesce(lowered("received_tutoring").isin("true", "1", "yes", "y"), F.lit(False))


def flag_is(df: DataFrame, name: str, target: bool) -> Column:
    """A flag compared with TRUE or FALSE; unknown and absent flags match neither."""
    if name not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col(name) == F.lit(target), F.lit(False))


def high_need(df: DataFrame) -> Column:
    """F12."""
    return flag_is(df, "ell", True) | flag_is(df, "iep", True) | flag_is(df, "economic_disadvantage", True)


def dosage_band_conditions(h: Column, target: float) -> dict[str, Column]:
    """A5: left-closed bands [edge, next edge) of the target, first and last open-ended."""
    cuts = [F.lit(target * edge) for edge in DOSAGE_EDGES]
    conditions = [h < cuts[0]]
    conditions += [(h >= low) & (h < high) for low, high in zip(cuts, cuts[1:])]
    conditions += [h >= cuts[-1]]
    return dict(zip(DOSAGE_SHARES, conditions))


def dosage_category(h: Column, target: float) -> Column:
    """Right-closed bands (edge, next edge]; differs from A5 on the boundaries.

    A target of zero has no bands below it, so every tutored student is at 100%+.
    """
    if target <= 0:
        return F.when(h > 0, DOSAGE_LABELS[-1])
    band = F.when(h <= 0, F.lit(None).cast("string"))
    for label, edge in zip(DOSAGE_LABELS, DOSAGE_EDGES):
        band = band.when(h <= F.lit(target * edge), label)
    return band.when(h.isNotNull(), DOSAGE_LABELS[-1])


def score_level(
    score: Column, cuts: Sequence[float] = LEVEL_CUTS, labels: Sequence[str] = LEVEL_LABELS
) -> Column:
    """P20: left-closed score bands."""
    level = F.when(score.isNull(), F.lit(None).cast("string"))
    for cut, label in zip(cuts, labels):
        level = level.when(score < F.lit(cut), label)
    return level.otherwise(labels[-1])


def score_bin(score: Column) -> Column:
    """Right-closed score bands; outside (0, 1000] is NULL."""
    band = F.when(score <= F.lit(SCORE_FLOOR), F.lit(None).cast("string"))
    for cut, label in zip((*LEVEL_CUTS, SCORE_CEILING), LEVEL_LABELS):
        band = band.when(score <= F.lit(cut), label)
    return band


def proficiency_rank(level: Column) -> Column:
    """Index of the first listed phrase found in a (trimmed) label, last when none is."""
    text = F.lower(level)
    rank = None
    for index, phrase in enumerate(PROFICIENCY_PHRASES):
        hit = text.contains(phrase)
        rank = F.when(hit, F.lit(index)) if rank is None else rank.when(hit, F.lit(index))
    return rank.otherwise(F.lit(len(PROFICIENCY_PHRASES)))


def grade_band(grade: Column, bands: Sequence[tuple[int, int]]) -> Column:
    """Label of the inclusive grade range a grade falls in, NULL outside all of them."""
    label = None
    for low, high in bands:
        inside = grade.between(low, high)
        label = F.when(inside, grade_band_label(low, high)) if label is None else label.when(
            inside, grade_band_label(low, high)
        )
    return label


def grade_band_label(low: int, high: int) -> str:
    return f"Grades {low}-{high}" if low >= 0 else f"Pre-K-{high}"


def dose_response_weight(
    h: Column,
    kind: str = "logarithmic",
    reference_hours: float = 55.0,
    threshold_hours: float = 20.0,
    enabled: bool = True,
) -> Column:
    """How much of the full effect a number of hours earns."""
    reference = F.lit(float(reference_hours))
    if not enabled:
        return F.lit(1.0)
    if kind == "linear":
        return h / reference
    if kind == "logarithmic":
        return F.when(h <= 0, F.lit(0.0)).otherwise(F.log1p(h) / F.log1p(reference))
    if kind == "threshold":
        span = float(reference_hours) - float(threshold_hours)
        above = (h - F.lit(float(threshold_hours))) / F.lit(span) if span > 0 else F.lit(1.0)
        return F.when(h < F.lit(float(threshold_hours)), F.lit(0.0)).otherwise(above)
    return F.lit(1.0)


def subgroup_multiplier(df: DataFrame, factors: Mapping[str, float], base: float = 1.0) -> Column:
    """Base times one factor per flag that is TRUE."""
    product = F.lit(float(base))
    for name, factor in factors.items():
        product = product * F.when(flag_is(df, name, True), F.lit(float(factor))).otherwise(F.lit(1.0))
    return product


def enrolment_probability(df: DataFrame, factors: Mapping[str, float], base: float) -> Column:
    """P23 for enrolment, never above 0.95."""
    return F.least(subgroup_multiplier(df, factors, base), F.lit(0.95))
