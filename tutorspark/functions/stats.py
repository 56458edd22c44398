"""Statistics Spark has no built-in for."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIGNIFICANT, MARGINAL = 0.05, 0.10
WEEKS_PER_SD = 43.0


def share(part: Column, whole: Column) -> Column:
    """Percentage, NULL when the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated front to back; NaN if it does not
    settle."""
    floor = 1e-300
    numerator_ratio = 1.0
    denominator_ratio = 1.0 / (1.0 - (a + b) * x / (a + 1.0) or floor)
    value = denominator_ratio
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            denominator_ratio = 1.0 / (1.0 + term * denominator_ratio or floor)
            numerator_ratio = 1.0 + term / numerator_ratio or floor
            step = denominator_ratio * numerator_ratio
            value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    return math.nan


def _log_beta(a: float, b: float) -> float:
    """log B(a, b); for large a by the expansion of the gamma ratio, where lgamma would cancel."""
    if a > 1e6 and b < 1.0:
        shift = b * math.log(a) + b * (b - 1) / (2 * a)
        return math.lgamma(b) - shift
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    x = df / (df + t * t)
    y = t * t / (df + t * t)
    if y == 0.0:
        return 1.0
    if x == 0.0:
        return 0.0
    a, b = df / 2.0, 0.5
    log_front = a * math.log1p(-y) + b * math.log(y) - _log_beta(a, b)
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def _p_values(mean: pd.Series, sd: pd.Series, n: pd.Series) -> pd.Series:
    out = np.full(len(mean), np.nan)
    for i, (m, s, k) in enumerate(zip(mean, sd, n)):
        if pd.isna(m) or pd.isna(s) or pd.isna(k) or k < 2:
            continue
        if s == 0:
            out[i] = 0.0 if m != 0 else np.nan
        else:
            out[i] = t_two_sided(m / (s / math.sqrt(k)), k - 1.0)
    return pd.Series(out)


def t_test_p_value(mean: Column, sd: Column, n: Column) -> Column:
    """Two-sided one-sample t-test against zero, from already aggregated moments.

    The only Python in any plan; it sees one row per subject.
    """
    udf = F.pandas_udf(_p_values, T.DoubleType())
    p = udf(mean.cast("double"), sd.cast("double"), n.cast("double"))
    return F.when(~F.isnan(p), p)
