"""Tukey's pairwise comparison of group means (Tukey-Kramer for unequal groups).

The statistic of two groups is |mean difference| / sqrt(MSE / 2 (1/n + 1/m)); one grouped
aggregate gives all of it.  Its distribution, the studentised range, is a double
integral taken by Gauss-Legendre quadrature on the result rows (one per pair of
levels).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.exprs import num
from statloom.functions.special import norm_cdf

_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _rule(low: float, high: float, pieces: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points and weights on equal pieces of an interval."""
    edges = np.linspace(low, high, pieces + 1)
    half = (edges[1:] - edges[:-1]) / 2
    mid = (edges[1:] + edges[:-1]) / 2
    return (mid[:, None] + half[:, None] * _NODES).ravel(), (half[:, None] * _WEIGHTS).ravel()


_Z, _ZW = _rule(-8.5, 8.5, 2)
_DENSITY = _ZW * np.exp(-_Z * _Z / 2) / math.sqrt(2 * math.pi)


def range_cdf(w, k: int) -> np.ndarray:
    """Chance that the range of k standard normals is at most w."""
    w = np.atleast_1d(np.asarray(w, np.float64))
    inner = np.clip(norm_cdf(_Z)[None] - norm_cdf(_Z[None] - w[:, None]), 0.0, 1.0)
    return np.minimum(1.0, k * (_DENSITY * inner ** (k - 1)).sum(1))


def studentised_range_sf(q: float, k: int, df: float) -> float:
    """Chance of a studentised range above q for k means and df degrees of freedom."""
    if not q > 0:
        return 1.0
    if df > 25_000:
        return float(1 - range_cdf(q, k)[0])
    # s = sqrt(chi2_df / df) spreads about 1 by 1 / sqrt(2 df)
    spread = 1 / math.sqrt(2 * df)
    s, weight = _rule(max(0.0, 1 - 9 * spread), 1 + 12 * spread, 2)
    with np.errstate(divide="ignore"):
        log_f = (df / 2 * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2)
    return float(min(1.0, max(0.0, 1 - (weight * np.exp(log_f) * range_cdf(q * s, k)).sum())))


def studentised_range_quantile(p: float, k: int, df: float) -> float:
    """The value that the range exceeds with chance p."""
    low, high = 0.0, 1.0
    while studentised_range_sf(high, k, df) > p:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if studentised_range_sf(mid, k, df) > p else (low, mid)
    return high


def tukey_pairs(df: DataFrame, group: str, value: str, confidence: float = 0.95, with_p: bool = True) -> DataFrame:
    """``(group1, group2, n1, n2, difference, statistic, df_within)`` with ``p_value, low, high, significant``.

    ``difference`` is the second group's mean less the first's.  Groups of one value count for
    the means only; a null group or value is left out; null statistic without spread.
    """
    x = df.select(F.col(group).alias("g"), num(value).alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    g = x.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("s"))
    tot = g.agg(F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("dfw"),
                F.sum((F.col("n") - 1) * F.coalesce("s", F.lit(0.0))).alias("ssw"))
    one, two = (g.select(F.col("g").alias(f"group{i}"), F.col("n").alias(f"n{i}"), F.col("m").alias(f"m{i}")) for i in (1, 2))
    pairs = one.join(two, F.col("group1") < F.col("group2")).join(F.broadcast(tot))
    diff = F.col("m2") - F.col("m1")
    se = F.sqrt(F.try_divide(F.col("ssw"), F.col("dfw").cast("double")) / 2 * (1 / F.col("n1") + 1 / F.col("n2")))
    out = pairs.select("group1", "group2", "n1", "n2", diff.alias("difference"), F.try_divide(F.abs(diff), se).alias("statistic"),
                       F.col("dfw").alias("df_within"), F.col("k").alias("_k"), se.alias("_se"))
    if not with_p:
        return out.drop("_k", "_se")

    def tails(parts):
        known: dict = {}
        for pdf in parts:
            p, half = [], []
            for q, k, d, se in zip(pdf["statistic"], pdf["_k"], pdf["df_within"], pdf["_se"]):
                fit = q is not None and not math.isnan(q) and d > 0
                if fit and (k, d) not in known:
                    known[k, d] = studentised_range_quantile(1 - confidence, int(k), float(d))
                p.append(studentised_range_sf(float(q), int(k), float(d)) if fit else None)
                half.append(known[k, d] * se if fit else math.nan)
            yield pdf.assign(p_value=pd.Series(p, pdf.index, dtype="Float64"), half=half).drop(columns=["_k", "_se"])

    kinds = dict(x.dtypes)["g"]
    got = out.mapInPandas(tails, f"group1 {kinds}, group2 {kinds}, n1 long, n2 long, difference double, statistic double, "
                                 "df_within long, p_value double, half double")
    half = F.nanvl("half", F.lit(None).cast("double"))
    return got.select("group1", "group2", "n1", "n2", "difference", "statistic", "df_within", "p_value",
                      (F.col("difference") - half).alias("low"), (F.col("difference") + half).alias("high"),
                      (F.col("p_value") < 1 - confidence).alias("significant"))
