"""Distribution fitting by maximum likelihood, ranked by Kolmogorov-Smirnov distance.

Normal, exponential and lognormal parameters are moments; the gamma shape is Newton's
root of ln k - digamma(k) = ln mean - mean ln, again from moments; the Weibull shape takes
Newton steps whose sums of x^k, x^k ln x and x^k ln^2 x are one aggregate a round
for all columns together.  D is the largest gap between the fitted and the empirical
distribution over value cells (one row per distinct value), as for the KS test.

Cases: missing values are left out; families of positive values are fitted only to
columns whose smallest value is above zero; constant columns and columns of fewer than
two values are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.exprs import clean_numeric, numeric_columns, stack_long
from statloom.functions.ranks import cumulate, value_cells
from statloom.functions.special import gammainc_upper, norm_cdf

FAMILIES = ("normal", "exponential", "lognormal", "gamma", "weibull")
MAX_ROUNDS = 60


def digamma(x: float) -> float:
    """Recurrence up to 10, then the asymptotic series."""
    out = 0.0
    while x < 10:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 10:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_shape(s: float) -> float:
    """Root of ln k - digamma(k) = s for s > 0."""
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)  # a known first guess
    for _ in range(100):
        step = (math.log(k) - digamma(k) - s) / (1 / k - trigamma(k))
        new = k - step if k - step > 0 else k / 2
        if abs(new - k) <= 1e-13 * k:
            return new
        k = new
    return k


def _weibull_shapes(x: DataFrame, st: dict[str, dict]) -> dict[str, float]:
    """Newton on every column at once; values are divided by their geometric mean first, so that no power overflows."""
    k = {c: 1.2 / max(s["sdln"], 1e-9) for c, s in st.items()}
    open_cols = [c for c, s in st.items() if s["sdln"] > 0]
    done = {c: math.inf for c, s in st.items() if not s["sdln"] > 0}
    for _ in range(MAX_ROUNDS):
        if not open_cols:
            break
        aggs = []
        for i, c in enumerate(open_cols):
            y = F.log(F.col(c)) - F.lit(st[c]["mln"])
            p = F.exp(y * F.lit(k[c]))
            aggs += [F.sum(p).alias(f"a{i}"), F.sum(p * y).alias(f"b{i}"), F.sum(p * y * y).alias(f"c{i}")]
        r = x.agg(*aggs).first()
        for i, c in list(enumerate(open_cols)):
            a, b, cc = r[f"a{i}"], r[f"b{i}"], r[f"c{i}"]
            step = (b / a - 1 / k[c]) / ((cc * a - b * b) / (a * a) + 1 / k[c] ** 2)
            new = k[c] - step if k[c] - step > 0 else k[c] / 2
            if abs(new - k[c]) <= 1e-12 * k[c]:
                done[c] = new
            k[c] = new
        open_cols = [c for c in open_cols if c not in done]
    return {**k, **done}


def _moments(x: DataFrame, cols: list[str]) -> dict[str, dict]:
    logs = {c: F.log(F.when(F.col(c) > 0, F.col(c))) for c in cols}
    r = x.agg(*[a.alias(f"{k}{i}") for i, c in enumerate(cols) for k, a in {
        "n": F.count(c), "m": F.avg(c), "s": F.stddev_pop(c), "lo": F.min(c), "ml": F.avg(logs[c]),
        "sl": F.stddev_pop(logs[c])}.items()]).first()
    out = {}
    for i, c in enumerate(cols):
        if (r[f"n{i}"] or 0) >= 2 and r[f"s{i}"] > 0:
            out[c] = {"n": r[f"n{i}"], "mean": r[f"m{i}"], "sd": r[f"s{i}"], "low": r[f"lo{i}"],
                      "mln": r[f"ml{i}"], "sdln": r[f"sl{i}"]}
    return out


def _fitted(c: str, s: dict, families, weibull: dict[str, float], power: dict[str, float]) -> list[tuple]:
    """(column, family, first and second parameter, log likelihood) of the families that fit the column's sign."""
    n, mean, mln = s["n"], s["mean"], s["mln"]
    out = []
    if "normal" in families:
        out.append((c, "normal", mean, s["sd"], -n / 2 * (math.log(2 * math.pi * s["sd"] ** 2) + 1)))
    if s["low"] > 0:
        if "exponential" in families:
            out.append((c, "exponential", 1 / mean, None, -n * (math.log(mean) + 1)))
        if "lognormal" in families:
            out.append((c, "lognormal", mln, s["sdln"], -n * (mln + 0.5 * (math.log(2 * math.pi * s["sdln"] ** 2) + 1))))
        if "gamma" in families:
            gap = math.log(mean) - mln
            if gap > 0:
                k = gamma_shape(gap)
                scale = mean / k
                out.append((c, "gamma", k, scale, n * ((k - 1) * mln - k - k * math.log(scale) - math.lgamma(k))))
        if "weibull" in families and math.isfinite(weibull[c]):
            k = weibull[c]
            scale = math.exp(mln) * power[c] ** (1 / k)
            out.append((c, "weibull", k, scale, n * (math.log(k) - k * math.log(scale) + (k - 1) * mln - 1)))
    return out


def distribution(family: str, a: float, b: float | None, v: np.ndarray) -> np.ndarray:
    """The fitted distribution function at ``v``."""
    if family == "normal":
        return norm_cdf((v - a) / b)
    with np.errstate(divide="ignore"):
        if family == "exponential":
            return -np.expm1(-a * v)
        if family == "lognormal":
            return norm_cdf((np.log(v) - a) / b)
        if family == "gamma":
            return 1 - gammainc_upper(np.full(len(v), a), v / b)
        return -np.expm1(-(v / b) ** a)


def fit_distributions(df: DataFrame, cols: list[str] | None = None, families=FAMILIES, with_ks: bool = True) -> DataFrame:
    """``(column_name, family, parameter1, parameter2, n, log_likelihood, aic, ks, rank)``; rank by ks (without: by aic).

    Parameters: normal mean and deviation, exponential rate, lognormal mean and deviation
    of the logarithm, gamma and Weibull shape and scale.
    """
    cols = cols or numeric_columns(df)
    spark = df.sparkSession
    x = clean_numeric(df, cols)
    st = _moments(x, cols)
    positive = {c: s for c, s in st.items() if s["low"] > 0}
    weibull, power = {}, {}
    if "weibull" in families and positive:
        weibull = _weibull_shapes(x, positive)
        r = x.agg(*[F.avg(F.exp((F.log(F.col(c)) - F.lit(s["mln"])) * F.lit(weibull[c] if math.isfinite(weibull[c]) else 1.0)))
                    .alias(f"p{i}") for i, (c, s) in enumerate(positive.items())]).first()
        power = {c: r[f"p{i}"] for i, c in enumerate(positive)}
    rows = [t for c, s in st.items() for t in _fitted(c, s, families, weibull, power)]
    fits = [(c, f, a, b, int(st[c]["n"]), ll, 2.0 * (1 if b is None else 2) - 2 * ll) for c, f, a, b, ll in rows]
    schema = "column_name string, family string, parameter1 double, parameter2 double, n long, log_likelihood double, aic double"
    out = spark.createDataFrame(fits, schema)
    if with_ks:
        out = out.join(F.broadcast(_ks(x, list(st), rows)), ["column_name", "family"], "left")
    w = Window.partitionBy("column_name").orderBy("ks" if with_ks else "aic", "family")  # a row a family
    return out.withColumn("rank", F.row_number().over(w))


def _ks(x: DataFrame, cols: list[str], fits: list[tuple]) -> DataFrame:
    """``(column_name, family, ks)``; each task keeps the largest gaps of its cells."""
    spark = x.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, family string, ks double")
    cells = cumulate(value_cells(stack_long(x, cols), ["column_name"]), ["column_name"])

    def gaps(parts):
        worst: dict[tuple[str, str], float] = {}
        for pdf in parts:
            for c, own in pdf.groupby("column_name"):
                v, n = own["value"].to_numpy(float), own["n"].to_numpy(float)
                low = own["cum_before"].to_numpy(float) / n
                high = (own["cum_before"] + own["cnt"]).to_numpy(float) / n
                for column, family, a, b, _ in fits:
                    if column == c:
                        f = distribution(family, a, b, v)
                        gap = float(np.maximum(high - f, f - low).max())
                        worst[c, family] = max(worst.get((c, family), 0.0), gap)
        yield pd.DataFrame([(*k, g) for k, g in worst.items()], columns=["column_name", "family", "ks"])

    found = cells.select("column_name", "value", "cnt", "cum_before", "n").mapInPandas(
        gaps, "column_name string, family string, ks double")
    return found.groupBy("column_name", "family").agg(F.max("ks").alias("ks"))
