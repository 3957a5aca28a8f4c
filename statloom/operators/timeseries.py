"""Time series.

Raw rows are resampled with a hash aggregate on ``(series, bucket)``; every
later step works on the resampled series, whose length is bounded by the
calendar (buckets), not by the data volume, so per-series windows are safe.
Series are long frames ``(series, bucket, v)``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.exprs import num, numeric_columns, time_columns

# Fixed values that must equal the reference's behaviour.
DERIVED_SUFFIXES = ["_year", "_month", "_day", "_quarter", "_dayofweek", "_weekend", "_days_since",
                    "_encoded"]
MAX_SERIES = 5
MIN_POINTS = 10
MIN_DECOMPOSE = 24
MAX_LAGS = 40


def ts_columns(df: DataFrame, date_col: str | None = None, max_series: int = MAX_SERIES) -> DataFrame:
    """``(role, column_name, ordinal)``: the time column and up to ``max_series`` value columns.

    Only typed timestamps (or the named column) qualify as the time axis.
    Value columns: numeric, not a derived date/encoding column, more than one
    distinct value and positive std over rows with a valid time.
    """
    spark = df.sparkSession
    times = [date_col] if date_col else time_columns(df)
    schema = "role string, column_name string, ordinal int"
    if not times:
        return spark.createDataFrame([], schema)
    tc = times[0]
    cand = [c for c in numeric_columns(df) if not any(s in c.lower() for s in DERIVED_SUFFIXES)]
    valid = df.filter(F.col(tc).isNotNull())
    ok = []
    if cand:
        # more than one distinct value <=> min < max: no distinct count needed
        r = valid.select(*[num(c).alias(c) for c in cand]).agg(*[a for i, c in enumerate(cand) for a in (
            (F.min(c) < F.max(c)).alias(f"d{i}"), F.stddev_samp(c).alias(f"s{i}"))]).first()
        ok = [c for i, c in enumerate(cand) if r[f"d{i}"] and (r[f"s{i}"] or 0) > 0][:max_series]
    rows = [("time", tc, 0)] + [("value", c, i + 1) for i, c in enumerate(ok)]
    return spark.createDataFrame(rows, schema)


def _weekly_bucket(ts):
    """Week ending Sunday (pandas ``resample('W')`` label)."""
    return F.date_trunc("week", ts) + F.expr("INTERVAL 6 DAYS")


def resample(df: DataFrame, ts_col: str, value_cols: list[str], freq: str = "auto", by: list[str] | None = None) -> DataFrame:
    """Mean per bucket, long form ``(series, bucket, v)``; empty buckets dropped.

    ``freq='auto'`` follows the reference: > 365 rows daily, > 52 weekly,
    otherwise the raw points.  ``by``: a series per value column and segment, named
    ``column|segment|...``.
    """
    if freq == "auto":
        n = df.filter(F.col(ts_col).isNotNull()).count()
        freq = "day" if n > 365 else "week" if n > 52 else "raw"
    ts = F.col(ts_col)
    bucket = (F.date_trunc("day", ts) if freq == "day" else _weekly_bucket(ts) if freq == "week"
              else ts)
    segment = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by or []]
    long = df.filter(ts.isNotNull()).select(bucket.alias("bucket"), F.inline(F.array(*[
        F.struct(F.concat_ws("|", F.lit(c), *segment).alias("series"), F.col(c).cast("double").alias("v")) for c in value_cols])))
    out = long.groupBy("series", "bucket").agg(F.avg("v").alias("v"))
    return out.filter(F.col("v").isNotNull()).select("series", "bucket", "v")


def ts_status(series: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """T2 gates: ``(series, n, status)``, status ``ok``, ``too few points`` or ``constant``."""
    g = series.groupBy("series").agg(F.count("v").alias("n"), F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    return g.select("series", "n", F.when(F.col("n") < min_points, "too few points").when(
        F.col("_lo") == F.col("_hi"), "constant").otherwise("ok").alias("status"))


def usable_series(series: DataFrame) -> DataFrame:
    """The points of the series that pass the gates."""
    return series.join(ts_status(series).filter("status = 'ok'").select("series"), "series", "left_semi")


def _positions(series: DataFrame) -> DataFrame:
    w = Window.partitionBy("series").orderBy("bucket")
    return (series.withColumn("pos", (F.row_number().over(w) - 1).cast("long"))
            .withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series"))))


def ts_trend(series: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Least-squares line on position 0..n-1: slope, intercept, R2, labels."""
    p = _positions(series)
    g = p.groupBy("series").agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("v", "pos").alias("slope"),
        F.regr_intercept("v", "pos").alias("intercept"),
        F.var_pop("v").alias("_vy"), F.var_pop("pos").alias("_vx"))
    # a constant series has nothing to explain: 0
    r2 = F.coalesce(F.try_divide(F.col("slope") * F.col("slope") * F.col("_vx"), F.col("_vy")), F.lit(0.0))
    return g.filter(F.col("n") >= min_points).select(
        "series", "n", "slope", "intercept", r2.alias("r2"),
        F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing")
         .otherwise("flat").alias("direction"),
        F.when(r2 > 0.7, "strong").when(r2 > 0.3, "moderate").otherwise("weak").alias("strength"))


def ts_trend_curves(series: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """``(series, method, n, intercept, slope, curvature, r2)`` of linear, polynomial and exponential trends.

    Polynomial: intercept + slope pos + curvature pos^2, by polynomials that are orthogonal over positions
    0..n-1, so all coefficients are single sums.  Exponential: exp(intercept + slope pos), fitted to the
    logarithm, only for series above zero; its r2 is that of the logarithm.
    """
    p = _positions(series.filter(F.col("v").isNotNull())).filter(F.col("n") >= min_points)
    n = F.col("n").cast("double")
    p1 = F.col("pos") - (n - 1) / 2
    p2 = p1 * p1 - (n * n - 1) / 12
    v, lv = F.col("v"), F.log(F.when(F.col("v") > 0, F.col("v")))
    g = p.select("series", "n", "v", p1.alias("p1"), p2.alias("p2"), lv.alias("lv")).groupBy("series", "n").agg(
        F.avg("v").alias("m"), F.sum(F.col("p1") * v).alias("s1"), F.sum(F.col("p2") * v).alias("s2"),
        F.sum(F.col("p1") * F.col("p1")).alias("q1"), F.sum(F.col("p2") * F.col("p2")).alias("q2"),
        (F.var_pop("v") * F.count("v")).alias("sst"), F.count("lv").alias("nl"), F.avg("lv").alias("ml"),
        F.sum(F.col("p1") * F.col("lv")).alias("l1"), (F.var_pop("lv") * F.count("lv")).alias("lst"))
    b1, b2, l1, half = F.col("s1") / F.col("q1"), F.col("s2") / F.col("q2"), F.col("l1") / F.col("q1"), (n - 1) / 2
    none = F.lit(None).cast("double")
    share = lambda part, total: F.coalesce(F.try_divide(part, total), F.lit(0.0))

    def row(method, a, b, c, r2):
        return F.struct(F.lit(method).alias("method"), a.alias("intercept"), b.alias("slope"), c.alias("curvature"), r2.alias("r2"))

    rows = F.array(
        row("linear", F.col("m") - b1 * half, b1, none, share(b1 * F.col("s1"), F.col("sst"))),
        row("polynomial", F.col("m") - b1 * half + b2 * (half * half - (n * n - 1) / 12), b1 - b2 * (n - 1), b2,
            share(b1 * F.col("s1") + b2 * F.col("s2"), F.col("sst"))),
        F.when(F.col("nl") == F.col("n"), row("exponential", F.col("ml") - l1 * half, l1, none, share(l1 * F.col("l1"), F.col("lst")))))
    return g.select("series", "n", F.explode(rows).alias("t")).filter("t IS NOT NULL").select("series", "t.method", "n", "t.intercept",
                                                                                       "t.slope", "t.curvature", "t.r2")


def ts_line_with_trend(series: DataFrame) -> DataFrame:
    """Each point with its fitted trend value."""
    p = _positions(series)
    t = p.groupBy("series").agg(F.regr_slope("v", "pos").alias("slope"),
                                F.regr_intercept("v", "pos").alias("intercept"))
    return p.join(t, "series").select("series", "bucket", "pos", "v",
                                      (F.col("slope") * F.col("pos") + F.col("intercept")).alias("fitted"))


def ts_decompose(series: DataFrame, period: int) -> DataFrame:
    """T4: additive decomposition (centred moving average, phase means).

    Even periods use a window of ``period + 1`` with half weight at both ends.
    Trend is null where the window is incomplete; series with fewer than 24
    points are skipped.
    """
    p = _positions(series).filter(F.col("n") >= MIN_DECOMPOSE)
    k = period // 2
    w = Window.partitionBy("series").orderBy("pos")
    full = F.count("v").over(w.rowsBetween(-k, k)) == 2 * k + 1
    s = F.sum("v").over(w.rowsBetween(-k, k))
    if period % 2 == 0:
        ends = F.lag("v", k).over(w) + F.lead("v", k).over(w)
        trend = (s - 0.5 * ends) / period
    else:
        trend = s / period
    d = p.withColumn("trend", F.when(full, trend)).withColumn("_det", F.col("v") - F.col("trend"))
    d = d.withColumn("phase", F.col("pos") % period)
    ph = d.groupBy("series", "phase").agg(F.avg("_det").alias("_pm"))
    ph = ph.withColumn("seasonal", F.col("_pm") - F.avg("_pm").over(Window.partitionBy("series")))
    out = d.join(ph.select("series", "phase", "seasonal"), ["series", "phase"])
    return out.select("series", "bucket", "pos", "v", "trend", "seasonal",
                      (F.col("_det") - F.col("seasonal")).alias("resid"))


def auto_periods(series: DataFrame, rows: int) -> dict[int, list[str] | None]:
    """The reference's period by the table's rows with a time: 7 for daily, 4 for weekly series, else min(12, points / 2).

    Series per period; None stands for all (raw series have at most 52 points).
    """
    if rows > 52:
        return {7 if rows > 365 else 4: None}
    out: dict[int, list[str] | None] = {}
    for r in series.groupBy("series").agg(F.count("v").alias("n")).collect():
        out.setdefault(min(12, r.n // 2), []).append(r.series)
    return out


def ts_strength_auto(series: DataFrame, rows: int) -> DataFrame:
    """T4 with the automatic period; series of fewer than 24 points are left out."""
    parts = [ts_strength(series if names is None else series.filter(F.col("series").isin(names)), period)
             for period, names in auto_periods(series, rows).items() if period > 1]
    if not parts:
        return ts_strength(series.limit(0), 7)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ts_strength(series: DataFrame, period: int) -> DataFrame:
    """T4 summary: std of each component and the seasonality / trend flags."""
    d = ts_decompose(series, period)
    g = d.groupBy("series").agg(F.stddev_samp("seasonal").alias("seasonal_std"),
                                F.stddev_samp("trend").alias("trend_std"),
                                F.stddev_samp("resid").alias("resid_std"))
    return g.select("series", "seasonal_std", "trend_std", "resid_std",
                    (F.col("seasonal_std") > 0.5 * F.col("resid_std")).alias("has_seasonality"),
                    (F.col("trend_std") > 0.5 * F.col("resid_std")).alias("has_trend"),
                    F.lit(period).alias("period"))


def ts_acf(series: DataFrame, max_lags: int = MAX_LAGS) -> DataFrame:
    """T5: autocorrelation for lags 1..min(40, n // 4) (series with n > 10).

    ``acf_k = sum (x_t - m)(x_{t+k} - m) / sum (x_t - m)^2``; significant when
    ``|acf| > 2 / sqrt(n)``.  Lagged values come from ``lead`` over the
    per-series window (bounded by the number of buckets).
    """
    p = _positions(series).filter(F.col("n") > MIN_POINTS)
    w = Window.partitionBy("series").orderBy("pos")
    m = F.avg("v").over(Window.partitionBy("series"))
    p = p.withColumn("_d", F.col("v") - m)
    p = p.withColumns({f"_l{k}": F.lead("_d", k).over(w) for k in range(1, max_lags + 1)})
    leads = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_l{k}").alias("_dk"))
                      for k in range(1, max_lags + 1)])
    x = p.select("series", "n", "_d", F.inline(leads))
    nl = F.least(F.lit(max_lags), F.floor(F.col("n") / 4))
    num = x.filter(F.col("lag") <= nl).groupBy("series", "lag", "n").agg(
        F.sum(F.col("_d") * F.col("_dk")).alias("_num"))
    den = p.groupBy("series").agg(F.sum(F.col("_d") * F.col("_d")).alias("_den"))
    out = num.join(den, "series").select(
        "series", "lag", F.try_divide("_num", "_den").alias("acf"), "n")  # null for a constant series
    return out.withColumn("significant", F.abs("acf") > 2.0 / F.sqrt(F.col("n").cast("double")))


def ts_acf_summary(series: DataFrame, max_lags: int = MAX_LAGS) -> DataFrame:
    """T5 summary: lag-1 value, max |acf|, first 10 significant lags."""
    a = ts_acf(series, max_lags)
    return a.groupBy("series").agg(
        F.max(F.when(F.col("lag") == 1, F.col("acf"))).alias("lag1"),
        F.max(F.abs("acf")).alias("max_abs"),
        F.array_join(F.slice(F.array_sort(F.collect_list(F.when(F.col("significant"), F.col("lag")))),
                             1, 10).cast("array<string>"), ",").alias("significant_lags"),
        (F.sum(F.col("significant").cast("int")) > 0).alias("has_autocorrelation"))


def ts_range(df: DataFrame, ts_col: str) -> DataFrame:
    """First and last timestamp and the whole days between them."""
    t = F.col(ts_col)
    g = df.agg(F.min(t).alias("start"), F.max(t).alias("end"))
    return g.select(F.lit(ts_col).alias("date_column"), "start", "end",
                    F.timestamp_diff("DAY", F.col("start"), F.col("end")).alias("days"))


# --- ADF (T3): per-series OLS on the bounded resampled series -------------

# MacKinnon (1994, 2010) published response-surface values, constant-only case.
_TAU_MAX_C, _TAU_MIN_C, _TAU_STAR_C = 2.74, -18.83, -1.61
_TAU_C_SMALLP = [2.1659, 1.4412, 0.038269]
_TAU_C_LARGEP = [1.7339, 0.93202, -0.12745, -0.010368]
_CRIT_C = {"1%": [-3.43035, -6.5393, -16.786, -79.433],
           "5%": [-2.86154, -2.8903, -4.234, -40.04],
           "10%": [-2.56677, -1.5384, -2.809, 0.0]}


def _norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def mackinnon_p(tau: float) -> float:
    if tau > _TAU_MAX_C:
        return 1.0
    if tau < _TAU_MIN_C:
        return 0.0
    c = _TAU_C_SMALLP if tau <= _TAU_STAR_C else _TAU_C_LARGEP
    return _norm_cdf(sum(ci * tau ** i for i, ci in enumerate(c)))


def mackinnon_crit(nobs: int) -> dict[str, float]:
    return {k: sum(b / nobs ** i for i, b in enumerate(v)) for k, v in _CRIT_C.items()}


def _ols(y, X):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ beta
    ssr = float(resid @ resid)
    n, k = X.shape
    sigma2 = ssr / (n - k)
    cov = sigma2 * np.linalg.inv(X.T @ X)
    return beta, cov, ssr


def _design(x, lag, nobs):
    dx = np.diff(x)
    n = len(dx)
    rows = range(n - nobs, n)
    cols = [np.array([x[t] for t in rows])]  # level y_{t} for dy_t = y_{t+1} - y_t ... see adf
    for j in range(1, lag + 1):
        cols.append(np.array([dx[t - j] for t in rows]))
    X = np.column_stack(cols + [np.ones(nobs)])
    y = np.array([dx[t] for t in rows])
    return y, X


def adf_test(x: np.ndarray) -> dict:
    """ADF with constant; lag chosen by AIC on a common sample, then refit."""
    x = np.asarray(x, dtype=float)
    n = len(x)
    maxlag = int(math.ceil(12.0 * (n / 100.0) ** 0.25))
    maxlag = min(n // 2 - 2, maxlag)
    if maxlag < 0:
        raise ValueError("series too short")
    nobs_common = n - 1 - maxlag
    best, best_aic = 0, math.inf
    for lag in range(0, maxlag + 1):
        y, X = _design(x, lag, nobs_common)
        _, _, ssr = _ols(y, X)
        llf = -nobs_common / 2.0 * (math.log(2 * math.pi) + math.log(ssr / nobs_common) + 1)
        aic = -2 * llf + 2 * X.shape[1]
        if aic < best_aic:
            best, best_aic = lag, aic
    nobs = n - 1 - best
    y, X = _design(x, best, nobs)
    beta, cov, _ = _ols(y, X)
    tau = float(beta[0] / math.sqrt(cov[0, 0]))
    crit = mackinnon_crit(nobs)
    return {"adf_stat": tau, "p_value": mackinnon_p(tau), "used_lag": best, "nobs": nobs,
            "crit_1": crit["1%"], "crit_5": crit["5%"], "crit_10": crit["10%"]}


ADF_SCHEMA = T.StructType([
    T.StructField("series", T.StringType()), T.StructField("adf_stat", T.DoubleType()),
    T.StructField("p_value", T.DoubleType()), T.StructField("used_lag", T.LongType()),
    T.StructField("nobs", T.LongType()), T.StructField("crit_1", T.DoubleType()),
    T.StructField("crit_5", T.DoubleType()), T.StructField("crit_10", T.DoubleType()),
    T.StructField("stationary", T.BooleanType())])


def ts_adf(series: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller per series; see :mod:`statloom.operators.stationarity`."""
    from statloom.operators.stationarity import adf
    return adf(series)
