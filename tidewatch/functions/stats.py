"""p-values of the classic two-sample tests.

They run on one row per feature or test, after all distributed work, as Arrow
batches.  All are the large-sample forms: no exact small-sample tables.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_two_sided(t: float, df: float) -> float:
    if t is None or df is None or math.isnan(t) or not df > 0:
        return float("nan")
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def normal_two_sided(z: float) -> float:
    if z is None or math.isnan(z):
        return float("nan")
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_two_sided(a, b) for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def _normal_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(a) for a in z])


def _null_if_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t with ``df`` degrees of freedom."""
    return _null_if_nan(_student_p(t.cast("double"), df.cast("double")))


def normal_p(z: Column) -> Column:
    """``min(1, 2·P(Z > z))``; a negative ``z`` (continuity correction) gives 1."""
    return _null_if_nan(_normal_p(z.cast("double")))


def kolmogorov_p(d: Column, n1: Column, n2: Column) -> Column:
    """Two-sided p of the two-sample Kolmogorov–Smirnov statistic (asymptotic series)."""
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = (root + 0.12 + 0.11 / root) * d
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 * terms)))
