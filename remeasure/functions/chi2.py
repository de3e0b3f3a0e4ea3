"""The upper tail of the chi-square distribution, in logarithms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_upper_tail(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """ln P(X > x) for chi-square variables; nan where dof is below 1 or x isn't a number of at least 0.

    Series of the lower incomplete gamma function up to its mean, continued fraction beyond; the
    latter stays finite where the probability itself underflows.
    """
    x, dof = np.asarray(x, float), np.asarray(dof, float)
    out = np.full(x.shape, np.nan)
    valid = (dof >= 1) & (x >= 0)
    out[valid & (x == 0)] = 0.0
    out[valid & np.isinf(x)] = -np.inf
    at = np.flatnonzero(valid & (x > 0) & np.isfinite(x))
    a, h = dof[at] / 2, x[at] / 2
    lead = a * np.log(h) - h - _lgamma(a) if len(at) else a
    rounds = 200 + int(30 * math.sqrt(a.max())) if len(at) else 0
    low = h < a + 1
    i = np.flatnonzero(low)
    term = 1 / a[i]
    total, k = term.copy(), a[i].copy()
    for _ in range(rounds):
        k += 1
        term = term * h[i] / k
        total += term
        if not (np.abs(term) > 1e-16 * total).any():
            break
    out[at[i]] = np.log1p(-np.minimum(np.exp(lead[i]) * total, 1 - 1e-16))
    j = np.flatnonzero(~low)
    tiny = 1e-300
    b = h[j] + 1 - a[j]
    c, d = np.full(len(j), 1 / tiny), 1 / np.where(b == 0, tiny, b)
    f = d.copy()
    for n in range(1, rounds):
        step = -n * (n - a[j])
        b += 2
        d = step * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + step / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        change = c * d
        f *= change
        if not (np.abs(change - 1) > 1e-15).any():
            break
    out[at[j]] = lead[j] + np.log(f)
    return out


def chi2_log_sf(x: Column, dof: Column) -> Column:
    """Column form of ``log_upper_tail``; null where it is undefined."""

    def tail(x: pd.Series, dof: pd.Series) -> pd.Series:
        values = log_upper_tail(x.to_numpy(float), dof.to_numpy(float))
        return pd.Series(values).where(~np.isnan(values), None)

    return F.pandas_udf(tail, T.DoubleType())(x, dof)
