"""Distribution tails for p-values (vectorised numpy, used inside pandas UDFs).

p-values are computed on *result* rows (one per column, pair or group) after
Spark has done the aggregation, so these run on tiny batches.  Neither Spark
nor DuckDB exposes ``erf`` or incomplete beta / gamma functions.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-15
_TINY = 1e-300


def norm_sf(z):
    z = np.asarray(z, dtype=float)
    return 0.5 * np.vectorize(math.erfc)(z / math.sqrt(2.0))


def norm_cdf(z):
    return 1.0 - norm_sf(z)


def norm_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _betacf(a, b, x, iters=300):
    """Continued fraction for the incomplete beta (modified Lentz), vectorised."""
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < _TINY, _TINY, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < _TINY, _TINY, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < _EPS):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b), element-wise."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        am, bm, xm = a[mid], b[mid], x[mid]
        lg = (np.vectorize(math.lgamma)(am + bm) - np.vectorize(math.lgamma)(am)
              - np.vectorize(math.lgamma)(bm))
        front = np.exp(lg + am * np.log(xm) + bm * np.log1p(-xm))
        direct = xm < (am + 1.0) / (am + bm + 2.0)
        res = np.empty(xm.shape)
        if direct.any():
            res[direct] = front[direct] * _betacf(am[direct], bm[direct], xm[direct]) / am[direct]
        if (~direct).any():
            nd = ~direct
            res[nd] = 1.0 - front[nd] * _betacf(bm[nd], am[nd], 1.0 - xm[nd]) / bm[nd]
        out[mid] = res
    return out


def t_sf_two_sided(t, df):
    """P(|T| > |t|) for Student t with ``df`` degrees of freedom."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    x = df / (df + t * t)
    return betainc(df / 2.0, 0.5, x)


def f_sf(f, d1, d2):
    """P(F > f) for the F distribution."""
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    x = d2 / (d2 + d1 * f)
    return betainc(d2 / 2.0, d1 / 2.0, x)


def gammainc_upper(a, x):
    """Regularised upper incomplete gamma Q(a, x), element-wise."""
    a, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, x))
    out = np.empty(x.shape)
    for idx in np.ndindex(x.shape):
        out[idx] = _gammaq(a[idx], x[idx])
    return out


def _gammaq(a, x):
    if not (math.isfinite(a) and math.isfinite(x)) or a <= 0:
        return float("nan")
    if x <= 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * _EPS:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - gln)
    b = x + 1.0 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = _TINY if abs(d) < _TINY else d
        c = b + an / c
        c = _TINY if abs(c) < _TINY else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - gln) * h


def chi2_sf(x, k):
    return gammainc_upper(np.asarray(k, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


# --- pandas UDF wrappers (Arrow batches; applied to result rows only) ------

@F.pandas_udf(T.DoubleType())
def t_pvalue_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_sf_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def f_pvalue_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue_udf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(float), k.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def norm_pvalue_two_sided_udf(z: pd.Series) -> pd.Series:
    return pd.Series(2.0 * norm_sf(np.abs(z.to_numpy(float))))


@F.pandas_udf(T.DoubleType())
def norm_sf_udf(z: pd.Series) -> pd.Series:
    return pd.Series(norm_sf(z.to_numpy(float)))
