"""Upper tail probabilities of the F, chi-squared and normal distributions for single statistics."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY, _PRECISION, _STEPS = 1e-300, 1e-15, 10000


def _lentz(first: float, terms) -> float:
    """Value of first + a1/(b1 + a2/(b2 + ...)) by the modified Lentz method."""
    value = first or _TINY
    c, d = value, 0.0
    for a, b in terms:
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < _PRECISION:
            break
    return value


def regularized_beta(x: float, a: float, b: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - regularized_beta(1.0 - x, b, a)

    def terms():
        for i in range(1, _STEPS):
            m = i // 2
            top = m * (b - m) if i % 2 == 0 else -(a + m) * (a + b + m)
            yield top * x / ((a + i - 1) * (a + i)), 1.0

    log_front = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                 + a * math.log(x) + b * math.log1p(-x))
    return math.exp(log_front) / a / _lentz(1.0, terms())


def upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        total = term = 1.0 / a
        for i in range(1, _STEPS):
            term *= x / (a + i)
            total += term
            if term < total * _PRECISION:
                break
        return 1.0 - total * math.exp(log_front)
    terms = ((-i * (i - a), x + 2 * i + 1 - a) for i in range(1, _STEPS))
    return math.exp(log_front) / _lentz(x + 1.0 - a, terms)


def f_tail(f: float, df1: float, df2: float) -> float:
    return regularized_beta(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0)


def chi2_tail(x: float, df: float) -> float:
    return upper_gamma(df / 2.0, x / 2.0)


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def f_tail_column(f: Column, df1: Column, df2: Column) -> Column:
    """For result tables of a few rows; the work is one Arrow batch."""
    @F.pandas_udf("double")
    def tail(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else f_tail(x, y, z) for x, y, z in zip(a, b, c)], dtype="float64")
    return tail(f.cast("double"), df1.cast("double"), df2.cast("double"))
