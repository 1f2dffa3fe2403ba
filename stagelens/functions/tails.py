"""Upper tails of the t, F and chi-square distributions for small result tables.

Spark has no such functions. They are vectorised over Arrow batches and only
ever applied to tables with one row per test.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ROUNDS = 400
_TINY = 1e-300


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma by Stirling's series after shifting the argument above 10."""
    x = np.asarray(x, dtype=float).copy()
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift = np.where(low, shift - np.log(np.where(low, x, 1.0)), shift)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / x
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function by the modified Lentz method."""
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, _ROUNDS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + term / np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * c * d
    return h


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    inside = (x > 0) & (x < 1)
    xs = np.where(inside, x, 0.5)
    log_front = a * np.log(xs) + b * np.log1p(-xs) + _lgamma(a + b) - _lgamma(a) - _lgamma(b)
    direct = xs < (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(direct, a, b), np.where(direct, b, a), np.where(direct, xs, 1 - xs)
    part = np.exp(log_front) * _beta_fraction(aa, bb, xx) / aa
    value = np.where(direct, part, 1 - part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x)."""
    a, x = np.asarray(a, dtype=float), np.asarray(x, dtype=float)
    xs = np.where(x > 0, x, 1.0)
    front = np.exp(a * np.log(xs) - xs - _lgamma(a))
    # series for the lower part
    term = 1 / a
    total = term
    for k in range(1, _ROUNDS * 5):
        term = term * xs / (a + k)
        total = total + term
    lower = front * total
    # continued fraction for the upper part
    b = xs + 1 - a
    c = np.full_like(b, 1 / _TINY)
    d = 1 / np.where(np.abs(b) < _TINY, _TINY, b)
    h = d.copy()
    for k in range(1, _ROUNDS):
        an = -k * (k - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / np.where(np.abs(c) < _TINY, _TINY, c)
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
    value = np.where(xs < a + 1, 1 - lower, front * h)
    return np.where(x <= 0, 1.0, value)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    known = t.notna() & dof.notna()
    tt, nu = t.where(known, 0.0).to_numpy(float), dof.where(known, 1.0).to_numpy(float)
    return pd.Series(beta_inc(nu / 2, np.full_like(nu, 0.5), nu / (nu + tt * tt))).where(known.values)


@F.pandas_udf(T.DoubleType())
def f_upper(f: pd.Series, dof1: pd.Series, dof2: pd.Series) -> pd.Series:
    known = f.notna() & dof1.notna() & dof2.notna()
    x, d1, d2 = (s.where(known, 1.0).to_numpy(float) for s in (f, dof1, dof2))
    return pd.Series(beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))).where(known.values)


@F.pandas_udf(T.DoubleType())
def chi2_upper(x: pd.Series, dof: pd.Series) -> pd.Series:
    known = x.notna() & dof.notna()
    xx, nu = (s.where(known, 1.0).to_numpy(float) for s in (x, dof))
    return pd.Series(gamma_upper(nu / 2, xx / 2)).where(known.values)
