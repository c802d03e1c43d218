"""Normal, t and chi-square tails, vectorised, for p-values and limits of small result tables."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def _each(f, x):
    x = np.asarray(x, float)
    return np.array([f(v) for v in x.ravel()]).reshape(x.shape)


def normal_sf2(z):
    """Two-sided normal tail."""
    return _each(math.erfc, np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_inc(a, b, x):
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    x = np.clip(x, 0.0, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_each(math.lgamma, a + b) - _each(math.lgamma, a) - _each(math.lgamma, b) + a * np.log(x) + b * np.log1p(-x))
        low = front * _beta_fraction(a, b, x) / a
        high = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    out = np.where(x < (a + 1.0) / (a + b + 2.0), low, high)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_sf2(t, df):
    """Two-sided t tail; infinite or huge df falls back to the normal."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    big = ~np.isfinite(df) | (df > 1e7)
    d = np.where(big, 1.0, df)
    return np.where(big, normal_sf2(t), beta_inc(d / 2.0, 0.5, d / (d + t * t)))


def t_quantile(p, df):
    """Upper quantile for p > 0.5: bisection once per distinct (p, df)."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    pairs, where = np.unique(np.column_stack([p.ravel(), df.ravel()]), axis=0, return_inverse=True)
    target, nu = 2.0 * (1.0 - pairs[:, 0]), pairs[:, 1]
    lo = np.array([NormalDist().inv_cdf(x) for x in pairs[:, 0]])
    hi = lo + 1e-9
    for _ in range(60):
        short = t_sf2(hi, nu) > target
        if not short.any():
            break
        hi = np.where(short, lo + (hi - lo) * 4.0, hi)
    for _ in range(50):
        mid = (lo + hi) / 2.0
        above = t_sf2(mid, nu) > target
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        if np.all(hi - lo < 1e-13 * np.maximum(hi, 1.0)):
            break
    return ((lo + hi) / 2.0)[where.ravel()].reshape(p.shape)


def chi2_sf(x, df):
    """Chi-square upper tail through the regularised incomplete gamma function."""
    a, x = df / 2.0, x / 2.0
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        for n in range(1, 10000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-16:
                break
        return 1.0 - total * math.exp(log_front)
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h * math.exp(log_front)
