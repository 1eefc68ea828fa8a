"""Two-sided Student-t p-value, for the handful of rows a test table has."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function at df / (df + t*t), by its continued fraction."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    a, b = df[ok] / 2.0, np.full(ok.sum(), 0.5)
    x = df[ok] / (df[ok] + t[ok] ** 2)
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    if ok.any():
        with np.errstate(divide="ignore"):
            front = np.exp(lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        value = front * _fraction(p, q, z)
        out[ok] = np.where(z <= 0, flip * 1.0, np.where(flip, 1 - value, value))
    return out


def _fraction(a, b, x, steps: int = 400, tiny: float = 1e-300):
    """Modified Lentz evaluation."""
    c = np.ones_like(x)
    d = 1.0 / _away_from_zero(1 - (a + b) * x / (a + 1), tiny)
    h = d.copy()
    for m in range(1, steps):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / _away_from_zero(1 + term * d, tiny)
            c = _away_from_zero(1 + term / c, tiny)
            h = h * d * c
        near = np.abs(d * c - 1)
        if np.all(near < 1e-15):
            break
    return np.where(near < 1e-8, h, np.nan)  # not converged: no value rather than a wrong one


def _away_from_zero(v, tiny):
    return np.where(np.abs(v) < tiny, tiny, v)


@F.pandas_udf(T.DoubleType())
def t_test_p(t: pd.Series, df: pd.Series) -> pd.Series:
    p = two_sided_p(t.to_numpy(float), df.to_numpy(float))
    return pd.Series(p).where(~np.isnan(p), None)
