"""Statistics as aggregate or scalar columns. NULL in, NULL out, unless said otherwise."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Digits on which scores count as equal when they are ranked; summation order may move later ones.
TIE_DIGITS = 12


def correlation(covariance: Column, x_variance: Column, y_variance: Column) -> Column:
    """From the (co)variances of two columns, within [-1, 1]; 0 where one is constant."""
    r = F.coalesce(F.try_divide(covariance, F.sqrt(x_variance * y_variance)), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation of two columns over a group; 0 where either is constant."""
    return correlation(F.covar_pop(x, y), F.var_pop(x), F.var_pop(y))


def pearson_over(x: str, y: str, frame: WindowSpec) -> Column:
    """``pearson`` over the frame of each row; rows with a NULL don't count."""
    return correlation(F.covar_pop(x, y).over(frame), F.var_pop(x).over(frame), F.var_pop(y).over(frame))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def rmse(actual: Column, predicted: Column) -> Column:
    return F.sqrt(F.avg(F.pow(actual - predicted, F.lit(2.0))))


def sidak_alpha(alpha: float, comparisons: Column | int) -> Column:
    """The level of one of several comparisons that keeps the level of all."""
    return 1 - F.pow(F.lit(1 - alpha), 1.0 / (F.lit(comparisons) if isinstance(comparisons, int) else comparisons))


def fisher_threshold(samples: Column, z: Column | float) -> Column:
    """The correlation that z standard errors reach on Fisher's scale; NULL up to three samples."""
    return F.when(samples > 3, F.tanh((F.lit(z) if isinstance(z, float) else z) / F.sqrt(samples - 3)))


def critical_z(alpha: float, comparisons: int = 1) -> float:
    """Two-sided critical value after Sidak's correction."""
    if not 0 < alpha < 1 or comparisons < 1:
        raise ValueError("alpha must be inside (0, 1) and comparisons positive")
    return NormalDist().inv_cdf(1 - (1 - (1 - alpha) ** (1 / comparisons)) / 2)


#: Step and terms of the quadrature of the normal tail.
_STEP, _TERMS = 0.5, 13
#: Newton steps for the inverse of the tail.
_NEWTON = 12


def two_sided(z: Column) -> Column:
    """The probability that a standard normal value lies beyond z >= 0 on either side.

    A series near 0; else the trapezoidal rule for the integral of exp(-t^2) / (t^2 + x^2),
    x = z / sqrt(2), with the exact correction for the pole where it is near.
    """
    near = lambda v: 1 - math.sqrt(2 / math.pi) * (v - F.pow(v, F.lit(3)) / 6 + F.pow(v, F.lit(5)) / 40)
    value = F.element_at(F.transform(F.array(z.cast("double")), lambda v: F.when(v < 0.01, near(v)).otherwise(_tail(v))), 1)
    return F.when(z.isNotNull(), value)


def _tail(z: Column) -> Column:
    x = z / math.sqrt(2)
    square = x * x
    terms = F.lit(0.0)
    for n in range(1, _TERMS + 1):
        terms = terms + math.exp(-((n * _STEP) ** 2)) / ((n * _STEP) ** 2 + square)
    pole = F.when(x < math.pi / _STEP, 2 / (F.exp(2 * math.pi / _STEP * x) - 1)).otherwise(0.0)
    return _STEP / math.pi * x * F.exp(-square) * (1 / square + 2 * terms) - pole


def critical(level: Column) -> Column:
    """The z that a standard normal value exceeds on either side with probability ``level`` (0 < level < 1), by Newton's method on the tail's logarithm."""
    start = F.sqrt(-2 * F.ln(level / 2))

    def step(z: Column, _: Column) -> Column:
        tail = _tail(z)
        slope = -2 * F.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * tail)
        return F.greatest(z - (F.ln(tail) - F.ln(level)) / slope, z / 4)

    return F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON)), start, step)


def correlation_p(score: Column, samples: Column) -> Column:
    """Two-sided p-value of a correlation by Fisher's transformation; 1 up to three samples."""
    z = F.atanh(F.least(F.abs(score), F.lit(0.999999))) * F.sqrt(F.greatest(samples - 3, F.lit(0)))
    return F.when(samples <= 3, 1.0).otherwise(two_sided(z))


def relative_change_pct(value: Column | str, base: Column | str) -> Column:
    """(value / base - 1) in percent; NULL where either is NULL or the base is 0."""
    base = F.col(base) if isinstance(base, str) else base
    return (F.try_divide(value, F.nullif(base, F.lit(0.0))) - 1) * 100


def reduction_pct(value: Column | str, base: Column | str) -> Column:
    """By how many percent the base was reduced; 0 where the base is 0."""
    return F.coalesce(-relative_change_pct(value, base), F.lit(0.0))


def increase_pct(value: Column | str, base: Column | str) -> Column:
    """By how many percent the base was increased; 0 where the base is 0."""
    return F.coalesce(relative_change_pct(value, base), F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def floor_quantile(values: Column, q: float) -> Column:
    """The order statistic at floor(q (n - 1)) of an array, without interpolation; NULL for an empty array."""
    return F.get(F.sort_array(values), F.floor(q * (F.size(values) - 1)).cast("int"))


def out(x: Column | str, digits: int = 10) -> Column:
    """A figure as reported: rounded, and never a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


@F.pandas_udf(StringType())
def fixed10(x: pd.Series) -> pd.Series:
    """A figure with ten decimals, rounded from its exact binary value (the JVM formats the shortest decimal instead)."""
    return pd.Series([None if pd.isna(v) else f"{v:.10f}" for v in x], dtype=object)
