"""Moments, normal quantiles and uniforms that give the same value in any engine and any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Added, in units of the last digit, before rounding: engines part on which way exact ties go.
OFFSET = 3e-4


def tidy(value: Column, digits: int = 6) -> Column:
    """Rounded, exact ties upwards, and never minus zero."""
    return F.round(value + F.lit(OFFSET * 10.0**-digits), digits) + F.lit(0.0)


def skew(value: Column) -> Column:
    """Sample skewness with the bias correction of G1; null under three values or without spread."""
    n = F.count(value)
    return F.when((n > 2) & (F.stddev_pop(value) > 0), F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)) * F.skewness(value))


def excess_kurtosis(value: Column) -> Column:
    """Sample excess kurtosis with the bias correction of G2; null under four values or without spread."""
    n = F.count(value)
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0))
    return F.when((n > 3) & (F.stddev_pop(value) > 0), scale * ((n + 1) * F.kurtosis(value) + 6))


def jarque_bera(value: Column) -> Column:
    return F.count(value) / 6 * (F.pow(F.skewness(value), 2) + F.pow(F.kurtosis(value), 2) / 4)


def _polynomial(coefficients: list[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


#: The published rational approximation of the normal quantile (relative error under 1.15e-9).
PPF_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
PPF_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
PPF_TAIL = 0.02425


def normal_ppf(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1)."""
    q = p - 0.5
    middle = _polynomial(PPF_A, q * q) * q / _polynomial(PPF_B, q * q)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    tail = lambda t: _polynomial(PPF_C, t) / _polynomial(PPF_D, t)
    return F.when(p < PPF_TAIL, tail(low)).when(p > 1 - PPF_TAIL, -tail(high)).otherwise(middle)


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    z = (x - mean) / std
    return F.exp(-z * z / 2) / (std * F.sqrt(2 * F.pi()))


def uniform(seed: str, *key: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and key."""
    digest = F.md5(F.concat_ws("-", F.lit(seed), *(k.cast("string") for k in key)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def normal(seed: str, *key: Column) -> Column:
    """A standard normal number by Box and Muller, from two uniforms; zero is moved half a step off."""
    u = uniform(f"{seed}-u", *key) + F.lit(0.5 / 4294967296.0)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * uniform(f"{seed}-v", *key))
