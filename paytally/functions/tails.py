"""Tail probabilities for test results: a few rows per query, so a small vectorised helper is fine."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Ship the helpers with the job, so that workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if pd.isna(v) else math.erfc(v)).astype("float64")


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated forwards."""
    tiny = 1e-300

    def safe(v):
        return v if abs(v) > tiny else tiny

    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    c, value = 1.0, d
    for m in range(1, 10000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        before = value
        for term in (even, odd):
            d = 1.0 / safe(1.0 + term * d)
            c = safe(1.0 + term / c)
            value *= c * d
        if abs(value - before) <= 1e-15 * abs(value):
            return value
    raise ArithmeticError(f"incomplete beta fraction did not converge: a={a}, b={b}, x={x}")


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def student_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t. Where the second term of Fisher's expansion around the normal tail leaves
    less than about 1e-12, the expansion is used: the beta function loses digits for large ``df``."""
    t = abs(t)
    if t**4 * (t**2 + 1) ** 2 < 1e-6 * df**2 and df > 1e3:
        density = math.exp(-t * t / 2.0) / math.sqrt(2.0 * math.pi)
        first = t * (t**2 + 1) / (4.0 * df)
        second = t * (3 * t**6 - 7 * t**4 - 5 * t**2 - 3) / (96.0 * df**2)
        return min(1.0, max(0.0, math.erfc(t / math.sqrt(2.0)) + 2.0 * density * (first + second)))
    return beta_cdf(df / 2.0, 0.5, df / (df + t * t))


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    def p(v, n):
        return None if pd.isna(v) or pd.isna(n) else student_tail(v, n)

    return pd.Series([p(v, n) for v, n in zip(t, df)], dtype="float64")
