"""Tail probabilities that Spark has no function for, as vectorised functions over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0 or a <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _apply(f, *series: pd.Series) -> pd.Series:
    ok = np.logical_and.reduce([s.notna() for s in series])
    return pd.Series([f(*map(float, row)) if good else None for good, *row in zip(ok, *series)], dtype="float64")


def normal_p(z: Column) -> Column:
    """Two-sided probability of a z score."""

    @F.pandas_udf("double")
    def f(x: pd.Series) -> pd.Series:
        return _apply(lambda v: math.erfc(abs(v) / math.sqrt(2)), x)

    return f(z)


def student_p(t: Column, dof: Column) -> Column:
    """Two-sided probability of Student's t."""

    @F.pandas_udf("double")
    def f(x: pd.Series, n: pd.Series) -> pd.Series:
        return _apply(lambda v, d: _beta(d / 2, 0.5, d / (d + v * v)), x, n)

    return f(t, dof)


def chi2_p(x: Column, dof: Column) -> Column:
    """Upper tail of the chi square distribution."""

    @F.pandas_udf("double")
    def f(v: pd.Series, d: pd.Series) -> pd.Series:
        return _apply(lambda a, b: _gamma_upper(b / 2, a / 2), v, d)

    return f(x, dof)
