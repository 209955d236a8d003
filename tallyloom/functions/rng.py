"""Counter-based random numbers: a value depends on seed and key alone, never on partitions, order or retries."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0
# A rational approximation of the inverse normal distribution (Acklam), relative error under 1.2e-9.
CENTRE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
CENTRE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)
TAIL_FROM = 0.02425


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.lit(str(c))


def uniform(*key) -> Column:
    """Uniform double in [0, 1) from 52 bits of the MD5 of the key's parts joined by ``|``."""
    text = F.concat_ws("|", *(_col(k).cast("string") for k in key))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / TWO_52


def order_key(*key) -> Column:
    """A key to shuffle rows by."""
    return F.md5(F.concat_ws("|", *(_col(k).cast("string") for k in key)))


def normal(*key) -> Column:
    """Standard normal by Box-Muller; 1 - u keeps the logarithm finite."""
    return F.sqrt(-2 * F.log(1 - uniform(*key, "a"))) * F.cos(2 * 3.141592653589793 * uniform(*key, "b"))


def uniform_int(low: int, high: int, *key) -> Column:
    """Inclusive."""
    return (F.floor(uniform(*key) * (high - low + 1)) + low).cast("long")


def uniform_date(low: str, high: str, *key) -> Column:
    """Inclusive days."""
    first, span = F.to_date(F.lit(low)), F.datediff(F.to_date(F.lit(high)), F.to_date(F.lit(low)))
    return F.date_add(first, F.floor(uniform(*key) * (span + 1)).cast("int"))


def uniform_timestamp(low: str, high: str, *key) -> Column:
    """Inclusive seconds."""
    first = F.unix_timestamp(F.to_timestamp(F.lit(low)))
    span = F.unix_timestamp(F.to_timestamp(F.lit(high))) - first
    return F.timestamp_seconds(first + F.floor(uniform(*key) * (span + 1)))


def draw(kind: str, params: dict, *key) -> Column:
    """One draw of an unbounded distribution."""
    if kind == "normal":
        return params["mean"] + params["std"] * normal(*key)
    if kind == "lognormal":
        return params["median"] * F.exp(params["sigma"] * normal(*key))
    if kind == "exponential":
        return -params["mean"] * F.log(1 - uniform(*key))
    raise ValueError(f"unknown distribution {kind}")


def _polynomial(x: Column, factors: tuple) -> Column:
    out = F.lit(factors[0])
    for f in factors[1:]:
        out = out * x + f
    return out


def inverse_normal(p: Column) -> Column:
    """The value below which a standard normal falls with probability ``p``."""

    def tail(q: Column) -> Column:
        x = F.sqrt(-2 * F.log(q))
        return _polynomial(x, TAIL) / _polynomial(x, TAIL_BELOW)

    x = p - 0.5
    centre = _polynomial(x * x, CENTRE) * x / _polynomial(x * x, CENTRE_BELOW)
    return F.when(p < TAIL_FROM, tail(p)).when(p > 1 - TAIL_FROM, -tail(1 - p)).otherwise(centre)


def _below(z: float) -> float:
    """Probability that a standard normal is below ``z``, also far out."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def truncated_normal(low: float | None, high: float | None, *key) -> Column:
    """Standard normal between two bounds by one uniform number: no redraws, no mass at the bounds."""
    a, b = -math.inf if low is None else low, math.inf if high is None else high
    mirrored = a > 0  # the lower side has the finer numbers
    first, last = (_below(-b), _below(-a)) if mirrored else (_below(a), _below(b))
    z = inverse_normal(F.greatest(F.lit(1e-300), first + uniform(*key) * (last - first)))
    z = -z if mirrored else z
    z = F.greatest(z, F.lit(float(a))) if low is not None else z  # the approximation's last digits
    return F.least(z, F.lit(float(b))) if high is not None else z


def bounded(kind: str, params: dict, low: float | None, high: float | None, *key) -> Column:
    """One draw of a distribution between bounds, by the inverse of its truncated distribution function."""
    if kind == "uniform":
        return low + uniform(*key) * (high - low)
    if low is None and high is None:
        return draw(kind, params, *key)
    if kind == "exponential":
        first, last = (None if x is None else 1 - math.exp(-max(0.0, x) / params["mean"]) for x in (low, high))
        u = (first or 0.0) + uniform(*key) * ((1.0 if last is None else last) - (first or 0.0))
        return -params["mean"] * F.log(1 - u)
    if kind == "normal":
        ends = (None if x is None else (x - params["mean"]) / params["std"] for x in (low, high))
        return params["mean"] + params["std"] * truncated_normal(*ends, *key)
    ends = (None if x is None or x <= 0 else math.log(x / params["median"]) / params["sigma"] for x in (low, high))
    return params["median"] * F.exp(params["sigma"] * truncated_normal(*ends, *key))
