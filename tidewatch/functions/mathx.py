"""Numeric column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

FLAT_STD = 1e-12  # a standard deviation below this is rounding noise of a constant series


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when the denominator is 0 or absent."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """z, with 0 for a flat or unknown baseline."""
    return F.when(std > FLAT_STD, (value - mean) / std).otherwise(F.lit(0.0))


def entropy(weights: Column, base2: bool = False) -> Column:
    """Shannon entropy of an array of non-negative counts; empty or zero gives 0."""
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x.cast("double"))
    log = F.log2 if base2 else F.log

    def add(acc: Column, x: Column) -> Column:
        p = x.cast("double") / total
        return acc - F.when(x > 0, p * log(p)).otherwise(F.lit(0.0))

    return F.when(total > 0, F.aggregate(weights, F.lit(0.0), add)).otherwise(F.lit(0.0))


def jensen_shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (natural log) of two sparse distributions held as maps.

    Keys missing on one side count as probability 0, so no dense vector is built.
    """

    def part(a: Column, b: Column) -> Column:
        mid = (a + b) / 2.0
        ka = F.when(a > 0, a * F.log(a / mid)).otherwise(F.lit(0.0))
        kb = F.when(b > 0, b * F.log(b / mid)).otherwise(F.lit(0.0))
        return ka + kb

    parts = F.map_values(
        F.map_zip_with(p, q, lambda k, a, b: part(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.coalesce(F.sqrt(F.greatest(total / 2.0, F.lit(0.0))), F.lit(0.0))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clip01(p: Column) -> Column:
    """Into 0..1; null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def clamp(index: Column, n: Column) -> Column:
    """Row index forced into 0..n-1 (0 when there are no rows)."""
    return F.greatest(F.lit(0), F.least(index, n - 1))


def interpolate(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise linear lookup on sorted knots, clipped at both ends."""
    n = F.size(xs)
    v = F.greatest(F.array_min(xs), F.least(F.array_max(xs), x))
    below = F.size(F.filter(xs, lambda k: k <= v))
    lo = F.greatest(F.lit(1), F.least(below, n - 1))
    x0, x1 = F.element_at(xs, lo), F.element_at(xs, lo + 1)
    y0, y1 = F.element_at(ys, lo), F.element_at(ys, lo + 1)
    inside = F.when(x1 > x0, y0 + (y1 - y0) * (v - x0) / (x1 - x0)).otherwise(y1)
    return F.when(x.isNotNull(), inside)


def pct_delta(value: Column, baseline: Column, digits: int = 1) -> Column:
    """Percentage change against a baseline, 0 when the baseline is 0 or absent."""
    raw = (value - baseline) / F.abs(baseline) * 100.0
    return F.when(baseline.isNotNull() & (baseline != 0), F.round(raw, digits)).otherwise(F.lit(0.0))


def bucket(value: Column, cuts: Sequence[Column | float]) -> Column:
    """Number of ascending cuts the value reaches (>=); null stays null."""
    expr = F.when(value.isNull(), F.lit(None))
    for i in range(len(cuts), 0, -1):
        cut = cuts[i - 1]
        expr = expr.when(value >= cut, F.lit(i))
    return expr.otherwise(F.lit(0)).cast("int")


def sample_skew(value: Column) -> Column:
    """Bias-corrected skewness; needs at least three values."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounding that never yields a negative zero."""
    return F.round(c, digits) + F.lit(0.0)
