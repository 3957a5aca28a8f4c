"""Augmented Dickey-Fuller test (T3) from Gram matrices along ranges of time.

The regressions of all lags on their common sample need only sums of products of the
differences, the level and the lagged differences.  Each range of a series
adds those up over its points, with the last values of the ranges before it as a halo;
the series' few matrices are added, and the lags are compared (AIC) and the best refitted
on the small sum.  The refit's extra points are among the first values of the series, which
travel with the halos.  Values are centred and scaled first.

Cases: series of fewer than ten points or without spread give no row; where the
regression is singular or fits without error (a straight line) the statistic and what follows
from it are null; missing values are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.timeranges import RANGE, time_ranges
from statloom.operators.timeseries import ADF_SCHEMA, MIN_POINTS, mackinnon_crit, mackinnon_p
from statloom.session import ensure_checkpoint_dir


def max_lag(n: int) -> int:
    return min(n // 2 - 2, int(math.ceil(12.0 * (n / 100.0) ** 0.25)))


def design(x: np.ndarray, lags: int, rows: np.ndarray) -> np.ndarray:
    """Difference, level, one and ``lags`` earlier differences, for differences ``rows`` of ``x``."""
    dx = np.diff(x)
    return np.column_stack([dx[rows], x[rows], np.ones(len(rows)), *[dx[rows - j] for j in range(1, lags + 1)]])


def solve(gram: np.ndarray, lag: int, nobs: int):
    """(squared residuals, t value of the level) of the regression on ``lag`` differences; None where it is singular or exact."""
    use = [1, 2, *range(3, 3 + lag)]
    a, b, yy = gram[np.ix_(use, use)], gram[use, 0], gram[0, 0]
    scale = np.sqrt(np.diag(a))
    if nobs <= len(use) or not (scale > 0).all():
        return None
    a = a / np.outer(scale, scale)
    if np.linalg.eigvalsh(a)[0] < 1e-12:
        return None
    inverse = np.linalg.inv(a)
    beta = inverse @ (b / scale)
    ssr = float(yy - beta @ (b / scale))
    if ssr <= 1e-12 * yy:
        return None
    return ssr, float(beta[0] / math.sqrt(ssr / (nobs - len(use)) * inverse[0, 0]))


def adf_from_sums(n: int, lags: int, gram: np.ndarray, head: np.ndarray) -> dict:
    """The test from the sums over the common sample and the first ``lags + 1`` values."""
    nobs = n - 1 - lags
    out = {"adf_stat": None, "p_value": None, "used_lag": None, "nobs": None, "crit_1": None, "crit_5": None, "crit_10": None,
           "stationary": None}
    best, best_aic = None, math.inf
    for lag in range(lags + 1):
        got = solve(gram, lag, nobs)
        if got is None:
            continue
        llf = -nobs / 2.0 * (math.log(2 * math.pi) + math.log(got[0] / nobs) + 1)
        aic = -2 * llf + 2 * (lag + 2)
        if aic < best_aic:
            best, best_aic = lag, aic
    if best is None:
        return out
    early = np.arange(best, lags)
    more = design(head, best, early)
    whole = gram[:3 + best, :3 + best] + more.T @ more
    got = solve(whole, best, n - 1 - best)
    if got is None:
        return out
    crit, p = mackinnon_crit(n - 1 - best), mackinnon_p(got[1])
    return {"adf_stat": got[1], "p_value": p, "used_lag": best, "nobs": n - 1 - best, "crit_1": crit["1%"], "crit_5": crit["5%"],
            "crit_10": crit["10%"], "stationary": p < 0.05}


def adf(series: DataFrame, per_range: int = RANGE) -> DataFrame:
    """T3 for every series of (series, bucket, v)."""
    ensure_checkpoint_dir(series.sparkSession)
    cut = time_ranges(series, per_range)
    st = cut.groupBy("series").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    st = st.where((F.col("n") >= MIN_POINTS) & (F.col("s") > F.abs(F.col("m")) * 1e-13)).checkpoint(eager=True)
    most = st.agg(F.max("n")).first()[0]
    if most is None:
        return series.sparkSession.createDataFrame([], ADF_SCHEMA)
    keep = max_lag(int(most)) + 1  # halo: the longest any series needs
    known = cut.join(st, "series").select("series", "part", "bucket", ((F.col("v") - F.col("m")) / F.col("s")).alias("v"), "n")

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("bucket")["v"].to_numpy()
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [pdf["n"].iloc[0]],
                             "size": [len(v)], "first": [v[:keep]], "last": [v[-keep:]]})

    edges = known.groupBy("series", "part").applyInPandas(
        ends, "series string, part int, n long, size long, first array<double>, last array<double>")

    def halos(pdf: pd.DataFrame) -> pd.DataFrame:
        """What came before each range of one series: how many points, the last of them, and the series' first."""
        before, last, head, out = 0, np.zeros(0), np.zeros(0), []
        for r in pdf.sort_values("part").itertuples():
            out.append((r.series, r.part, r.n, before, last))
            if len(head) < keep:
                head = np.concatenate([head, r.first])[:keep]
            before += r.size
            last = np.concatenate([last, r.last])[-keep:]
        return pd.DataFrame([(*o, head) for o in out], columns=["series", "part", "n", "before", "halo", "head"])

    states = edges.groupBy("series").applyInPandas(
        halos, "series string, part int, n long, before long, halo array<double>, head array<double>").checkpoint(eager=True)

    def sums(points: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        r = state.iloc[0]
        lags = max_lag(int(r["n"]))
        halo = np.asarray(r["halo"], np.float64)[-(lags + 1):] if r["before"] else np.zeros(0)
        x = np.concatenate([halo, points.sort_values("bucket")["v"].to_numpy()])
        # difference i ends at the range's own points; the common sample starts at difference `lags` of the series
        rows = np.arange(max(len(halo) - 1, lags, 0), len(x) - 1)
        d = design(x, lags, rows) if len(rows) else np.zeros((0, lags + 3))
        return pd.DataFrame({"series": [r["series"]], "n": [r["n"]], "gram": [(d.T @ d).ravel()], "head": [r["head"]]})

    grams = known.groupBy("series", "part").cogroup(states.groupBy("series", "part")).applyInPandas(
        sums, "series string, n long, gram array<double>, head array<double>")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        lags = max_lag(n)
        gram = np.sum([np.asarray(g) for g in pdf["gram"]], axis=0).reshape(lags + 3, lags + 3)
        got = adf_from_sums(n, lags, gram, np.asarray(pdf["head"].iloc[0])[:lags + 1])
        row = pd.DataFrame([{"series": pdf["series"].iloc[0], **got}])
        return row[[f.name for f in ADF_SCHEMA.fields]].astype(
            {"used_lag": "Int64", "nobs": "Int64", "stationary": "boolean"} | {c: "Float64" for c in (
                "adf_stat", "p_value", "crit_1", "crit_5", "crit_10")})

    return grams.groupBy("series").applyInPandas(test, ADF_SCHEMA)
