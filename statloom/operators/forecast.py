"""Partial autocorrelation, and forecasts by exponential smoothing along ranges of time.

PACF: the Levinson-Durbin recursion over the autocorrelations of a series (at most
``max_lags`` numbers in one array per series), as higher-order array functions.

Forecast: additive Holt-Winters smoothing (level, trend and, with a period, one
seasonal term per phase) takes its state x to F x + g (y - h x) at every point, an
affine map.  Affine maps compose, so a series of any length is cut into ranges of
time: each task composes the maps of its points, for all candidate parameters at
once; the ranges' maps (a small matrix each) are folded in order, which gives the
state before every range and at the end; a second pass takes each range from its
state and adds up the squared one-step errors.  The parameters with the smallest
sum forecast the next points.  Nothing but one range of one series meets in a task.

Cases: series shorter than two points (two periods, with a period) are left out;
buckets of a series must differ, null values are skipped; an empty frame gives no
rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.timeranges import RANGE, time_ranges
from statloom.operators.timeseries import MAX_LAGS, ts_acf
from statloom.session import ensure_checkpoint_dir

#: Fixed value: forecast length of the reference.
FORECAST_PERIODS = 12
#: Candidate smoothing parameters (level, trend, season).
ALPHAS = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)
BETAS = (0.0, 0.1, 0.3)
GAMMAS = (0.1, 0.3)


def ts_pacf(series: DataFrame, max_lags: int = MAX_LAGS) -> DataFrame:
    """``(series, lag, pacf, n, significant)`` for the lags of :func:`ts_acf`; null once a series is fully explained."""
    a = ts_acf(series, max_lags).where("acf IS NOT NULL")
    a = a.groupBy("series", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "acf"))), lambda s: s["acf"]).alias("r"))

    def step(state, k):
        phi = state["phi"]
        known = F.aggregate(F.zip_with(phi, F.reverse(F.slice("r", F.lit(1), k - 1)), lambda p, r: p * r),
                            F.lit(0.0), lambda s, v: s + v)
        ref = F.try_divide(F.element_at("r", k) - known, F.when(state["var"] > 1e-12, state["var"]))
        return F.struct(
            F.concat(F.zip_with(phi, F.reverse(phi), lambda p, q: p - ref * q), F.array(ref)).alias("phi"),
            F.concat(state["out"], F.array(ref)).alias("out"), (state["var"] * (1 - ref * ref)).alias("var"))

    none = F.lit([]).cast("array<double>")
    start = F.struct(none.alias("phi"), none.alias("out"), F.lit(1.0).alias("var"))
    solved = a.withColumn("out", F.aggregate(F.sequence(F.lit(1), F.size("r")), start, step, lambda s: s["out"]))
    out = solved.select("series", "n", F.posexplode("out").alias("i", "pacf"))
    return out.select("series", (F.col("i") + 1).alias("lag"), "pacf", "n",
                      (F.abs("pacf") > 2.0 / F.sqrt(F.col("n").cast("double"))).alias("significant"))


def candidates(period: int | None) -> np.ndarray:
    return np.array(list(itertools.product(ALPHAS, BETAS, GAMMAS if period else (0.0,))))


def start_state(first: np.ndarray, period: int | None) -> np.ndarray:
    """Level, trend and seasonal terms from the first points (two, or two periods)."""
    if not period:
        return np.array([first[0], first[1] - first[0]])
    level, later = first[:period].mean(), first[period:2 * period].mean()
    return np.concatenate([[level, (later - level) / period], first[:period] - level])


def smooth(states: np.ndarray, points: np.ndarray, params: np.ndarray, period: int | None, affine: bool = False):
    """Take states (candidate, term) or affine maps (candidate, term, column) through ``points``.

    The seasonal terms turn: the one of the next point stands first.  Returns the
    states and the sum of squared one-step errors (which means nothing for maps).
    """
    x = np.array(states, np.float64)
    shape = (-1,) + (1,) * (x.ndim - 2)
    a, b, g = (params[:, i].reshape(shape) for i in range(3))
    errors = np.zeros(len(params))
    for y in points:
        expected = x[:, 0] + x[:, 1] + (x[:, 2] if period else 0.0)
        e = -expected
        if affine:
            e[:, -1] += y  # the last column is the constant part
        else:
            e = e + y
            errors += (e * e).reshape(len(errors), -1).sum(1)
        level = x[:, 0] + x[:, 1] + a * e
        trend = x[:, 1] + a * b * e
        if period:
            season = x[:, 2] + g * (1 - a) * e
            x = np.concatenate([level[:, None], trend[:, None], x[:, 3:], season[:, None]], axis=1)
        else:
            x = np.stack([level, trend], axis=1)
    return x, errors


def identity(count: int, period: int | None) -> np.ndarray:
    """The affine map that changes nothing, once per candidate: columns are the terms and the constant."""
    size = 2 + (period or 0)
    return np.repeat(np.eye(size, size + 1)[None], count, axis=0)


def then(later: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The states that the maps take ``state`` to."""
    return np.einsum("cij,cj->ci", later[:, :, :-1], state) + later[:, :, -1]


def forecast(series: DataFrame, periods: int = FORECAST_PERIODS, period: int | None = None,
             params: np.ndarray | None = None, per_range: int = RANGE) -> DataFrame:
    """``(series, step, forecast, alpha, beta, gamma, sse, n)`` for the next ``periods`` points of every series.

    ``period``: length of the season (None: level and trend only).
    """
    ensure_checkpoint_dir(series.sparkSession)
    held = candidates(period) if params is None else np.asarray(params, np.float64)
    size, first_n = 2 + (period or 0), 2 * (period or 1)
    cut = time_ranges(series, per_range)
    heads = cut.withColumn("i", F.row_number().over(Window.partitionBy("series").orderBy("bucket"))).where(F.col("i") <= first_n)
    heads = heads.groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "v"))), lambda s: s["v"])
                                        .alias("first")).where(F.size("first") == first_n)
    # a range without its head's points smooths from the first point on, as every other
    known = cut.join(heads.select("series"), "series", "left_semi")
    count = len(held)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf.sort_values("bucket")["v"].to_numpy()
        maps, _ = smooth(identity(count, period), points, held, period, True)
        return pd.DataFrame({"series": [pdf["series"].iloc[0]], "part": [pdf["part"].iloc[0]], "map": [maps.ravel()],
                             "n": [len(points)]})

    maps = known.groupBy("series", "part").applyInPandas(compose, "series string, part int, map array<double>, n long")
    maps = maps.checkpoint(eager=True)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """States before each range of one series, and behind the last (part -1)."""
        state = np.repeat(start_state(np.asarray(pdf["first"].iloc[0]), period)[None], count, axis=0)
        out = []
        for r in pdf.sort_values("part").itertuples():
            out.append((r.series, r.part, state.ravel(), 0))
            state = then(np.asarray(r.map).reshape(count, size, size + 1), state)
        out.append((r.series, -1, state.ravel(), int(pdf["n"].sum())))
        return pd.DataFrame(out, columns=["series", "part", "state", "n"])

    states = maps.join(heads, "series").groupBy("series").applyInPandas(
        fold, "series string, part int, state array<double>, n long").checkpoint(eager=True)

    def errors(points: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        at = np.asarray(state["state"].iloc[0]).reshape(count, size)
        _, e = smooth(at, points.sort_values("bucket")["v"].to_numpy(), held, period)
        return pd.DataFrame({"series": points["series"].iloc[0], "candidate": np.arange(count), "sse": e})

    sse = known.groupBy("series", "part").cogroup(states.where("part >= 0").groupBy("series", "part")).applyInPandas(
        errors, "series string, candidate int, sse double")
    sse = sse.groupBy("series", "candidate").agg(F.sum("sse").alias("sse"))
    best = sse.groupBy("series").agg(F.min(F.struct("sse", "candidate")).alias("b")).select("series", "b.*")
    last = states.where("part < 0").join(best, "series")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in p]) for p in held])
    last = last.withColumns({"x": F.slice("state", F.col("candidate") * size + 1, size), "p": F.get(table, F.col("candidate"))})
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    value = F.element_at("x", 1) + F.col("step") * F.element_at("x", 2)
    if period:
        value = value + F.element_at("x", 3 + (F.col("step") - 1) % period)
    return ahead.select("series", "step", value.alias("forecast"), F.element_at("p", 1).alias("alpha"),
                        F.element_at("p", 2).alias("beta"), F.element_at("p", 3).alias("gamma"), "sse", "n")
