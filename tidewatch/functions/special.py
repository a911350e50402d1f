"""Tail probabilities for F and t statistics, on whole arrays (used inside tasks)."""

from __future__ import annotations

import math

import numpy as np

TINY, TOLERANCE, MOST_TERMS = 1e-300, 1e-14, 1_000_000
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_cf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz method).

    Terms are added until every value moves less than TOLERANCE; one that never does is nan.
    """
    lift = lambda v: np.where(np.abs(v) > TINY, v, TINY)
    c, d = np.ones_like(x), 1.0 / lift(1.0 - (a + b) * x / (a + 1.0))
    value, moving = d.copy(), np.ones(x.shape, dtype=bool)
    for m in range(1, MOST_TERMS):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / lift(1.0 + num * d)
            c = lift(1.0 + num / c)
            value = np.where(moving, value * c * d, value)
        moving &= np.abs(c * d - 1.0) >= TOLERANCE
        if not moving.any():
            return value
    return np.where(moving, np.nan, value)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) of arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(x <= 0.0, 0.0, 1.0)
    inside = (x > 0.0) & (x < 1.0)
    a, b, x = a[inside], b[inside], x[inside]
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) if len(a) else x
    low = x < (a + 1.0) / (a + b + 2.0)
    p, q, t = np.where(low, a, b), np.where(low, b, a), np.where(low, x, 1.0 - x)
    part = front * _beta_cf(p, q, t) / p
    out[inside] = np.where(low, part, 1.0 - part)
    return out


def f_tail(f, d1, d2) -> np.ndarray:
    """P(F > f); nan where f is nan."""
    f = np.asarray(f, dtype=float)
    usable = np.isfinite(f) & (f > 0)
    x = np.where(usable, d2 / (d2 + d1 * np.where(usable, f, 1.0)), np.where(f > 0, 0.0, 1.0))
    return np.where(np.isnan(f), np.nan, beta_inc(np.asarray(d2) / 2.0, np.asarray(d1) / 2.0, x))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|); nan where t is nan."""
    t = np.asarray(t, dtype=float)
    x = np.where(np.isfinite(t), df / (df + np.square(np.where(np.isfinite(t), t, 0.0))), 0.0)
    return np.where(np.isnan(t), np.nan, beta_inc(np.asarray(df) / 2.0, 0.5, x))
