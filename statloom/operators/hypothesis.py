"""Hypothesis tests and normality (H1-H5, N1-N4) and feature relevance (K1, K2).

Test statistics come from aggregations (moments, ranked value cells, group
sums); p-values are evaluated on the handful of result rows by the special
functions in ``functions.special``.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.exprs import clean_numeric, numeric_columns, stack_long, string_columns
from statloom.functions.ranks import cumulate, quantile_wide, value_cells
from statloom.session import ensure_checkpoint_dir
from statloom.functions.special import (f_pvalue_udf, norm_pvalue_two_sided_udf, norm_ppf,
                                        norm_sf, t_pvalue_udf)

MIN_N = 20           # tests need more than this many values
SHAPIRO_MAX = 5000   # Shapiro-Wilk below this many values, D'Agostino-Pearson otherwise
# Stephens' published Anderson-Darling normal-case critical values (15, 10, 5, 2.5, 1 %).
AD_LEVELS = [15.0, 10.0, 5.0, 2.5, 1.0]
AD_BASE = [0.576, 0.656, 0.787, 0.918, 1.092]


def _pop_moments(long: DataFrame) -> DataFrame:
    """``(column_name, n, mean, var_samp, g1, b2)``: population skewness and kurtosis."""
    g = long.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"),
        F.var_samp("value").alias("var"), F.skewness("value").alias("g1"),
        F.kurtosis("value").alias("g2"))
    return g.withColumn("b2", F.col("g2") + 3.0)


def dagostino_k2(n: Column, g1: Column, b2: Column) -> tuple[Column, Column]:
    """D'Agostino (1970) skewness Z and Anscombe-Glynn (1983) kurtosis Z (expressions)."""
    n = n.cast("double")
    y = g1 * F.sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2)))
    beta2 = (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
             / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))
    w2 = -1.0 + F.sqrt(2.0 * (beta2 - 1.0))
    delta = 1.0 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1.0))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    ya = y / alpha
    z1 = delta * F.log(ya + F.sqrt(ya * ya + 1.0))
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(varb2)
    sb1 = (6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
           * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1.0 + 4.0 / (sb1 * sb1)))
    term1 = 1.0 - 2.0 / (9.0 * a)
    denom = 1.0 + x * F.sqrt(2.0 / (a - 4.0))
    term2 = F.signum(denom) * F.pow((1.0 - 2.0 / a) / F.abs(denom), 1.0 / 3.0)
    z2 = F.when(denom != 0, (term1 - term2) / F.sqrt(2.0 / (9.0 * a)))
    return z1, z2


def normality_dagostino(df: DataFrame, cols: list[str] | None = None, alpha: float = 0.05,
                        limit_cols: int = 10) -> DataFrame:
    """H1 (large n): K2 = Z1^2 + Z2^2, p = exp(-K2 / 2) (chi-square, 2 df)."""
    cols = cols or numeric_columns(df)[:limit_cols]
    m = _pop_moments(stack_long(clean_numeric(df, cols), cols)).filter(F.col("n") > MIN_N)
    z1, z2 = dagostino_k2(F.col("n"), F.col("g1"), F.col("b2"))
    k2 = z1 * z1 + z2 * z2
    return m.select("column_name", "n", F.lit("dagostino_pearson").alias("test"),
                    k2.alias("statistic"), F.exp(-k2 / 2.0).alias("p_value")).withColumn(
        "is_normal", F.col("p_value") > alpha)


# --- Shapiro-Wilk (N1), Royston (1995) AS R94 -------------------------------

def _poly(c, x):
    return sum(ci * x ** i for i, ci in enumerate(c))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """W and p for 3 <= n <= 5000 (Royston's approximation)."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 3:
        raise ValueError("n >= 3 required")
    if x[-1] - x[0] == 0:
        return 1.0, 1.0
    w = min(float((shapiro_coefficients(n) @ x) ** 2 / ((x - x.mean()) @ (x - x.mean()))), 1.0)
    return w, shapiro_p(n, w)


def shapiro_coefficients(n: int) -> np.ndarray:
    """Weights of the order statistics 1..n."""
    i = np.arange(1, n + 1)
    m = np.array([norm_ppf(p) for p in (i - 0.375) / (n + 0.25)])
    mm = float(m @ m)
    u = 1.0 / math.sqrt(n)
    a = m / math.sqrt(mm)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        an = a[-1] + _poly([0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], u)
        if n > 5:
            an1 = a[-2] + _poly([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], u)
            phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
            a = m / math.sqrt(phi)
            a[-1], a[0], a[-2], a[1] = an, -an, an1, -an1
        else:
            phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * an ** 2)
            a = m / math.sqrt(phi)
            a[-1], a[0] = an, -an
    return a


def shapiro_p(n: int, w: float) -> float:
    if n == 3:
        return max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    ln1w = math.log(1.0 - w) if w < 1 else -math.inf
    if n <= 11:
        g = _poly([-2.273, 0.459], n)
        mu = _poly([0.5440, -0.39978, 0.025054, -6.714e-4], n)
        sigma = math.exp(_poly([1.3822, -0.77857, 0.062767, -0.0020322], n))
        if ln1w >= g:
            return 1e-99
        z = (-math.log(g - ln1w) - mu) / sigma
    else:
        ln = math.log(n)
        mu = _poly([-1.5861, -0.31082, -0.083751, 0.0038915], ln)
        sigma = math.exp(_poly([-0.4803, -0.082676, 0.0030302], ln))
        z = (ln1w - mu) / sigma
    return float(norm_sf(z))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _coefficients_udf(n: pd.Series) -> pd.Series:
    return n.map(lambda k: shapiro_coefficients(int(k)).tolist())


@F.pandas_udf(T.DoubleType())
def _shapiro_p_udf(n: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series([shapiro_p(int(k), float(x)) if x == x else None for k, x in zip(n, w)])


def normality_shapiro(df: DataFrame, cols: list[str] | None = None, status: bool = False) -> DataFrame:
    """Shapiro-Wilk per column with 20 < n < 5000.

    W is an aggregate over ranked value cells: each order statistic meets its
    coefficient by (column, position), so no column is gathered in one task.
    A constant column has W = 1, p = 1.  ``status`` adds a row, with a reason,
    for every column outside the gate.
    """
    cols = cols or numeric_columns(df)
    long = stack_long(clean_numeric(df, cols), cols)
    sizes = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    ok = sizes.filter((F.col("n") > MIN_N) & (F.col("n") < SHAPIRO_MAX))
    weights = ok.select("column_name", F.posexplode(_coefficients_udf("n")).alias("pos", "a"))
    inside = long.join(F.broadcast(ok.select("column_name", "mean")), "column_name")  # one row per column
    cum = cumulate(value_cells(inside, ["column_name", "mean"]), ["column_name", "mean"])
    each = cum.select("column_name", "value", "mean", F.explode(F.sequence(
        F.col("cum_before").cast("int"), (F.col("cum_before") + F.col("cnt") - 1).cast("int"))).alias("pos"))
    d = F.col("value") - F.col("mean")
    g = each.join(weights, ["column_name", "pos"]).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("a") * d).alias("_b"), F.sum(d * d).alias("_ss"),
        (F.min("value") == F.max("value")).alias("_flat"))
    w = F.when(F.col("_flat"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("_b") * F.col("_b"), F.col("_ss"))))
    out = g.select("column_name", "n", w.alias("statistic"), "_flat")
    out = out.select("column_name", "n", "statistic", F.when(F.col("_flat"), F.lit(1.0)).otherwise(
        _shapiro_p_udf("n", "statistic")).alias("p_value"))
    if not status:
        return out
    base = df.sparkSession.createDataFrame([(c,) for c in cols], "column_name string").join(
        sizes.select("column_name", F.col("n").alias("_n")), "column_name", "left")
    n = F.coalesce("_n", F.lit(0))
    return base.join(out.drop("n"), "column_name", "left").select(
        "column_name", n.alias("n"), "statistic", "p_value",
        F.when(n <= MIN_N, "too_few_values").when(n >= SHAPIRO_MAX, "too_many_values").otherwise("ok").alias("status"))


def _norm_tails(z: Column) -> tuple[Column, Column]:
    """(ln F(z), ln(1 - F(z))) using the direct tail of A&S 26.2.17."""
    from statloom.functions.exprs import _AS_B, _AS_P, _INV_SQRT_2PI
    az = F.abs(z)
    t = 1.0 / (1.0 + _AS_P * az)
    poly = t * (_AS_B[0] + t * (_AS_B[1] + t * (_AS_B[2] + t * (_AS_B[3] + t * _AS_B[4]))))
    tail = F.lit(_INV_SQRT_2PI) * F.exp(-az * az / 2.0) * poly
    lo, hi = F.lit(1e-300), F.lit(1.0 - 1e-16)
    small = F.greatest(tail, lo)
    big = F.least(1.0 - tail, hi)
    lnf = F.log(F.when(z < 0, small).otherwise(big))
    lnsf = F.log(F.when(z > 0, small).otherwise(big))
    return lnf, lnsf


def normality_anderson(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Anderson-Darling A2 against N(mean, std n-1) with Stephens' critical values.

    Ranks come from value cells: a cell at positions ``a..b`` contributes
    ``(b^2 - (a-1)^2) ln F + ((2n+1) cnt - (b(b+1) - (a-1)a) + ... ) ln(1-F)``
    in closed form, so no per-row rank is materialised.
    """
    cols = cols or numeric_columns(df)
    x = clean_numeric(df, cols)
    long = stack_long(x, cols)
    st = long.groupBy("column_name").agg(F.avg("value").alias("mean"),
                                         F.stddev_samp("value").alias("std"))
    cum = cumulate(value_cells(long, ["column_name"]), ["column_name"])
    j = cum.join(F.broadcast(st), "column_name").filter(F.col("n") > MIN_N)
    z = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))  # null for a constant column
    lnf, lnsf = _norm_tails(z)
    a = F.col("cum_before") + 1
    b = F.col("cum_before") + F.col("cnt")
    n = F.col("n")
    w_f = (b * b - (a - 1) * (a - 1)).cast("double")                 # sum of (2i - 1)
    w_s = ((2 * n + 1) * F.col("cnt") - (b * (b + 1) - (a - 1) * a)).cast("double")  # sum (2n - 2i + 1)
    g = j.groupBy("column_name", "n").agg(F.sum(F.when(z.isNotNull(), w_f * lnf + w_s * lnsf)).alias("_s"))
    nn = F.col("n").cast("double")
    a2 = -nn - F.col("_s") / nn  # null for a constant column
    denom = 1.0 + 4.0 / nn - 25.0 / (nn * nn)
    crit = [F.round(F.lit(v) / denom, 3).alias(f"crit_{str(l).replace('.', '_')}")
            for v, l in zip(AD_BASE, AD_LEVELS)]
    return g.select("column_name", "n", a2.alias("statistic"), *crit)


def _ks_p(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Asymptotic Kolmogorov p with Stephens' small-sample correction."""
    out = []
    for di, ni in zip(d, n):
        lam = (math.sqrt(ni) + 0.12 + 0.11 / math.sqrt(ni)) * di
        s = sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
        out.append(min(1.0, max(0.0, 2 * s)))
    return np.array(out)


@F.pandas_udf(T.DoubleType())
def _ks_p_udf(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(_ks_p(d.to_numpy(float), n.to_numpy(float)))


def normality_ks(df: DataFrame, cols: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """One-sample Kolmogorov-Smirnov D against N(mean, std n-1).

    A cell at positions ``a..b`` gives the candidates ``b/n - F(v)`` and
    ``F(v) - (a-1)/n``; D is their maximum (one aggregation).
    """
    from statloom.functions.exprs import norm_cdf
    cols = cols or numeric_columns(df)
    long = stack_long(clean_numeric(df, cols), cols)
    st = long.groupBy("column_name").agg(F.avg("value").alias("mean"),
                                         F.stddev_samp("value").alias("std"))
    cum = cumulate(value_cells(long, ["column_name"]), ["column_name"])
    j = cum.join(F.broadcast(st), "column_name").filter(F.col("n") > MIN_N)
    f = norm_cdf(F.try_divide(F.col("value") - F.col("mean"), F.col("std")))  # null for a constant column
    nn = F.col("n").cast("double")
    dplus = (F.col("cum_before") + F.col("cnt")) / nn - f
    dminus = f - F.col("cum_before") / nn
    g = j.groupBy("column_name", "n").agg(F.max(F.when(f.isNotNull(), F.greatest(dplus, dminus))).alias("statistic"))
    return g.withColumn("p_value", _ks_p_udf("statistic", "n")) if with_p else g


def distribution_traits(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Mean, median, skew, kurtosis, normal (Shapiro p, else KS p > 0.05),
    symmetric (|skew| < 0.5), outliers (any value outside the IQR fences)."""
    from statloom.operators.describe import moments
    from statloom.operators.outliers import outliers_iqr
    cols = cols or numeric_columns(df)
    m = moments(df, cols).filter(F.col("count") > MIN_N)
    med = quantile_wide(df, cols, [0.5], ["median"])
    sw = normality_shapiro(df, cols).select("column_name", F.col("p_value").alias("_sw"))
    ks = normality_ks(df, cols).select("column_name", F.col("p_value").alias("_ks"))
    keyed = df.withColumn("_rowkey", F.monotonically_increasing_id())
    iq = outliers_iqr(keyed, "_rowkey", cols).select("column_name", F.col("count").alias("_out"))
    j = (m.join(med, "column_name").join(sw, "column_name", "left").join(ks, "column_name", "left")
         .join(iq, "column_name", "left"))
    normal_p = F.when(F.col("count") < SHAPIRO_MAX, F.col("_sw")).otherwise(F.col("_ks"))
    return j.select("column_name", "mean", "median", "skew", "kurt",
                    (normal_p > 0.05).alias("is_normal"), (F.abs("skew") < 0.5).alias("is_symmetric"),
                    (F.col("_out") > 0).alias("has_outliers"))


def normality_tests(df: DataFrame, cols: list[str] | None = None, confidence: float = 0.95,
                    limit_cols: int = 10) -> DataFrame:
    """H1 gate: Shapiro-Wilk when 20 < n < 5000, D'Agostino-Pearson when n >= 5000."""
    cols = cols or numeric_columns(df)[:limit_cols]
    alpha = 1.0 - confidence
    sw = normality_shapiro(df, cols).select("column_name", "n", F.lit("shapiro_wilk").alias("test"),
                                            "statistic", "p_value")
    dp = normality_dagostino(df, cols, alpha).filter(F.col("n") >= SHAPIRO_MAX).drop("is_normal")
    return sw.unionByName(dp).withColumn("is_normal", F.col("p_value") > alpha)


# --- two-sample comparisons (H2-H4) -----------------------------------------

MAX_COMPARED = 4   # columns compared when the caller names none


def _pairs(cols: list[str]) -> list[tuple[str, str]]:
    return list(combinations(cols, 2))


def t_test_pairs(df: DataFrame, cols: list[str] | None = None, with_p: bool = True) -> DataFrame:
    """H2 + H4: pooled two-sample t-test between columns and Cohen-style effect size."""
    cols = cols or numeric_columns(df)[:MAX_COMPARED]
    pairs = _pairs(cols)
    used = list(dict.fromkeys(c for p in pairs for c in p))
    st = stack_long(clean_numeric(df, used), used).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    spark = df.sparkSession
    pr = spark.createDataFrame(pairs, "var1 string, var2 string")
    a = st.select(F.col("column_name").alias("var1"), F.col("n").alias("n1"), F.col("m").alias("m1"),
                  F.col("v").alias("v1"))
    b = st.select(F.col("column_name").alias("var2"), F.col("n").alias("n2"), F.col("m").alias("m2"),
                  F.col("v").alias("v2"))
    j = pr.join(a, "var1").join(b, "var2")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    dof = n1 + n2 - 2
    sp2 = F.try_divide((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2"), dof)
    t = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(sp2 * (1.0 / n1 + 1.0 / n2)))
    eff = F.try_divide(F.col("m1") - F.col("m2"), F.sqrt((F.col("v1") + F.col("v2")) / 2.0))
    out = j.select("var1", "var2", F.lit("t_test").alias("test"), t.alias("statistic"),
                   dof.alias("df"), eff.alias("effect_size"))
    return out.withColumn("p_value", t_pvalue_udf("statistic", "df")) if with_p else out


def mann_whitney(df: DataFrame, cols: list[str] | None = None, with_p: bool = True,
                 pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """H3: Mann-Whitney U between columns (or the given pairs); two-sided normal p with tie
    correction and continuity.  Ranks over the union come from value cells."""
    cols = cols or numeric_columns(df)[:MAX_COMPARED]
    pairs = _pairs(cols) if pairs is None else pairs
    used = list(dict.fromkeys(c for p in pairs for c in p))
    long = stack_long(clean_numeric(df, used), used)
    spark = df.sparkSession
    pr = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)],
                               "var1 string, var2 string, pair int")
    side1 = long.join(F.broadcast(pr.select("pair", F.col("var1").alias("column_name"))), "column_name")
    side2 = long.join(F.broadcast(pr.select("pair", F.col("var2").alias("column_name"))), "column_name")
    tagged = (side1.select("pair", "value", F.lit(1).alias("s1"))
              .unionByName(side2.select("pair", "value", F.lit(0).alias("s1"))))
    cells = tagged.groupBy("pair", "value").agg(F.count(F.lit(1)).alias("cnt"),
                                                F.sum("s1").alias("c1"))
    cum = cumulate(cells, ["pair"])
    rank = F.col("cum_before") + (F.col("cnt") + 1) / 2.0
    g = cum.groupBy("pair").agg(F.sum(F.col("c1") * rank).alias("r1"), F.sum("c1").alias("n1"),
                                F.max("n").alias("_nn"),
                                F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt")).alias("ties"))
    n1 = F.col("n1").cast("double")
    n2 = (F.col("_nn") - F.col("n1")).cast("double")
    nn = F.col("_nn").cast("double")
    u1 = F.col("r1") - n1 * (n1 + 1) / 2.0
    u = F.greatest(u1, n1 * n2 - u1)
    mu = n1 * n2 / 2.0
    sigma = F.sqrt(n1 * n2 / 12.0 * ((nn + 1) - F.try_divide(F.col("ties"), nn * (nn - 1))))
    z = F.try_divide(u - mu - 0.5, sigma)
    out = g.join(pr, "pair").select("var1", "var2", F.lit("mann_whitney").alias("test"),
                                    u1.alias("statistic"), z.alias("z"))
    return (out.withColumn("p_value", F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), norm_pvalue_two_sided_udf(F.col("z")))))
            if with_p else out)


def compare_pairs(df: DataFrame, cols: list[str] | None = None, confidence: float = 0.95) -> DataFrame:
    """H2/H3 dispatch: t-test when both columns pass the normality gate, else Mann-Whitney."""
    cols = cols or numeric_columns(df)[:MAX_COMPARED]
    alpha = 1.0 - confidence
    norm = {r[0]: r[1] for r in normality_tests(df, cols, confidence)
            .select("column_name", "is_normal").collect()}
    tt = t_test_pairs(df, cols).select("var1", "var2", "test", "statistic", "p_value", "effect_size")
    other = [(a, b) for a, b in _pairs(cols) if not (norm.get(a) and norm.get(b))]
    if other:  # only the pairs that need it are ranked
        mw = mann_whitney(df, cols, pairs=other).select(
            "var1", "var2", F.col("test").alias("_t"), F.col("statistic").alias("_s"), F.col("p_value").alias("_p"))
        ranked = F.col("_t").isNotNull()
        tt = tt.join(mw, ["var1", "var2"], "left").select(
            "var1", "var2", F.coalesce("_t", "test").alias("test"), F.when(ranked, F.col("_s")).otherwise(F.col("statistic")).alias("statistic"),
            F.when(ranked, F.col("_p")).otherwise(F.col("p_value")).alias("p_value"), "effect_size")
    return tt.withColumn("significant", F.col("p_value") < alpha)


def anova_oneway(df: DataFrame, cat_cols: list[str] | None = None, num_cols: list[str] | None = None,
                 with_p: bool = True, min_group: int = 5) -> DataFrame:
    """H5: one-way ANOVA of each numeric column across the levels of each categorical.

    Needs 2-10 levels, groups with more than 5 values, at least 2 groups.
    """
    cat_cols = cat_cols or string_columns(df)[:3]
    num_cols = num_cols or numeric_columns(df)[:3]
    parts = []
    for cat in cat_cols:
        x = clean_numeric(df, num_cols, keep=[cat]).filter(F.col(cat).isNotNull())
        long = stack_long(x, num_cols, keep=[cat])
        levels = x.agg(F.countDistinct(cat).alias("k")).first()["k"]
        if not 2 <= levels <= 10:
            continue
        g = long.groupBy("column_name", F.col(cat).alias("level")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"),
            F.var_samp("value").alias("v"), F.avg("value").alias("m"))
        g = g.filter(F.col("n") > min_group)
        tot = g.groupBy("column_name").agg(
            F.count(F.lit(1)).alias("k"), F.sum("n").alias("_nn"),
            (F.sum("s") / F.sum("n")).alias("gm"))
        j = g.join(tot, "column_name")
        ss = j.groupBy("column_name", "k", "_nn").agg(
            F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"),
            F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw"))
        k, nn = F.col("k").cast("double"), F.col("_nn").cast("double")
        fstat = F.try_divide(F.try_divide(F.col("ssb"), k - 1), F.try_divide(F.col("ssw"), nn - k))
        parts.append(ss.filter(F.col("k") >= 2).select(
            F.lit(cat).alias("categorical"), F.col("column_name").alias("numeric"),
            fstat.alias("statistic"), (k - 1).alias("df_between"), (nn - k).alias("df_within"),
            F.col("k").cast("long").alias("n_groups")))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "categorical string, numeric string, statistic double, df_between double, "
                "df_within double, n_groups long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return (out.withColumn("p_value", f_pvalue_udf("statistic", "df_between", "df_within"))
            if with_p else out)


# --- feature relevance (K1, K2) -----------------------------------------------

def importance_correlation(df: DataFrame, cols: list[str] | None = None, target: str | None = None,
                           with_p: bool = True) -> DataFrame:
    """K2: |Pearson r| of each feature with the target (last numeric column by
    default) over complete cases, with p, descending."""
    from statloom.operators.correlate import pair_stats
    cols = cols or numeric_columns(df)
    target = target or cols[-1]
    feats = [c for c in cols if c != target]
    cc = clean_numeric(df, cols).na.drop(subset=cols)
    ps = pair_stats(cc, cols, [(f, target) for f in feats])
    r = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx") * F.col("syy")))
    n = F.col("n").cast("double")
    out = ps.select(F.col("var1").alias("feature"), F.lit(target).alias("target"), "n",
                    F.abs(r).alias("abs_r"), r.alias("r"))
    out = out.withColumn("t_stat", F.col("r") * F.sqrt(
        F.try_divide(n - 2, F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0)))))
    return out.withColumn("p_value", t_pvalue_udf("t_stat", n - 2)).drop("r") if with_p else out.drop("r")


def mutual_information(df: DataFrame, cols: list[str] | None = None, target: str | None = None,
                       bins: int = 10) -> DataFrame:
    """K1 (re-aimed): mutual information between quantile-binned features and target.

    Bin = number of exact deciles strictly below the value.  ``mi`` is in
    nats; ``mi_norm = mi / max(mi)``.  Complete cases only.
    """
    cols = cols or numeric_columns(df)
    target = target or cols[-1]
    feats = [c for c in cols if c != target]
    # cut points and binning must see the same values: cut lineage once
    ensure_checkpoint_dir(df.sparkSession)
    cc = clean_numeric(df, cols).na.drop(subset=cols).checkpoint(eager=True)
    probs = [i / bins for i in range(1, bins)]
    q = quantile_wide(cc, cols, probs, [f"q{i}" for i in range(1, bins)])
    cuts = {r["column_name"]: [r[f"q{i}"] for i in range(1, bins)] for r in q.collect()}
    if not cuts:
        raise ValueError("mutual information: no row has all columns")

    def binned(c):
        e = F.lit(0)
        for v in cuts[c]:
            e = e + (F.col(c) > F.lit(v)).cast("int")
        return e

    b = cc.select(*[binned(c).alias(c) for c in cols])
    # one aggregation: joint bin counts of every (feature, target) pair
    joint = (b.select(F.col(target).alias("by"), F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("bx")) for f in feats])))
        .groupBy("feature", "bx", "by").agg(F.count(F.lit(1)).alias("nxy")))
    # the joint table has at most features x bins x bins rows
    wf = Window.partitionBy("feature")
    j = (joint.withColumn("nx", F.sum("nxy").over(wf.partitionBy("feature", "bx")))
         .withColumn("ny", F.sum("nxy").over(wf.partitionBy("feature", "by")))
         .withColumn("n", F.sum("nxy").over(wf)))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    out = j.groupBy("feature").agg(F.sum(term).alias("mi")).select(
        "feature", F.lit(target).alias("target"), "mi")
    mx = F.max("mi").over(Window.partitionBy())  # one row per feature (schema-sized)
    return out.select("feature", "target", "mi",
                      F.when(mx > 0, F.col("mi") / mx).otherwise(F.col("mi")).alias("mi_norm"))


def chi_square(df: DataFrame, a: str, b: str, with_p: bool = True) -> DataFrame:
    """Chi-square test of independence between two categoricals (advertised, 2.13)."""
    x = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    obs = x.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = obs.groupBy(a).agg(F.sum("o").alias("ra"))
    cb = obs.groupBy(b).agg(F.sum("o").alias("cb"))
    tot = obs.agg(F.sum("o").alias("n"), F.countDistinct(a).alias("ka"),
                  F.countDistinct(b).alias("kb")).first()  # three scalars
    n, ka, kb = float(tot["n"] or 0), tot["ka"], tot["kb"]
    # expected counts over all level pairs, including empty cells: sum o^2/e - n
    j = obs.join(ra, a).join(cb, b)
    stat = j.agg((F.sum(F.col("o") * F.col("o") * F.lit(n) / (F.col("ra") * F.col("cb")))).alias("_s"))
    out = stat.select(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                      (F.col("_s") - F.lit(n)).alias("statistic"),
                      F.lit(float((ka - 1) * (kb - 1))).alias("df"))
    if with_p:
        from statloom.functions.special import chi2_pvalue_udf
        out = out.withColumn("p_value", chi2_pvalue_udf("statistic", "df"))
    return out


def kruskal_wallis(df: DataFrame, group: str, value: str, with_p: bool = True) -> DataFrame:
    """Kruskal-Wallis H across the levels of ``group`` (advertised, 2.13), tie-corrected."""
    x = clean_numeric(df, [value], keep=[group]).filter(F.col(group).isNotNull() & F.col(value).isNotNull())
    # one row per (group, value): a value that a third of the rows share is a handful of cells
    own = x.groupBy(group, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("c"))
    cells = own.groupBy(F.lit(0).alias("_g"), "value").agg(F.sum("c").cast("long").alias("cnt"))
    cum = cumulate(cells, ["_g"])
    ranked = cum.select("value", (F.col("cum_before") + (F.col("cnt") + 1) / 2.0).alias("rank"),
                        "cnt", "n")
    j = own.join(ranked, "value")
    g = j.groupBy(group).agg(F.sum(F.col("rank") * F.col("c")).alias("rs"), F.sum("c").alias("ni"), F.max("n").alias("_nn"))
    t_sum = ranked.agg(F.sum(F.pow(F.col("cnt").cast("double"), 3) - F.col("cnt"))).first()[0] or 0.0
    h = g.agg(F.sum(F.col("rs") * F.col("rs") / F.col("ni")).alias("_s"), F.max("_nn").alias("_nn"),
              F.count(F.lit(1)).alias("k")).withColumn("t", F.lit(float(t_sum)))
    nn = F.col("_nn").cast("double")
    hstat = F.try_divide(F.try_divide(F.lit(12.0), nn * (nn + 1)) * F.col("_s") - 3 * (nn + 1),
                         1 - F.try_divide(F.col("t"), nn * nn * nn - nn))
    out = h.select(F.lit(group).alias("group"), F.lit(value).alias("value"), hstat.alias("statistic"),
                   (F.col("k") - 1).cast("double").alias("df"))
    if with_p:
        from statloom.functions.special import chi2_pvalue_udf
        out = out.withColumn("p_value", chi2_pvalue_udf("statistic", "df"))
    return out


__all__ = ["normality_dagostino", "normality_shapiro", "normality_anderson", "normality_ks",
           "normality_tests", "distribution_traits", "t_test_pairs", "mann_whitney", "compare_pairs",
           "anova_oneway", "importance_correlation", "mutual_information", "chi_square",
           "kruskal_wallis", "shapiro_wilk", "combinations"]


def qq_normal(df: DataFrame, cols: list[str] | None = None, points: int = 99) -> DataFrame:
    """Q-Q frame against the normal: ``(column_name, prob, sample_q, normal_q)``.

    ``prob = i / (points + 1)``; sample quantiles are exact (linear), normal
    quantiles are ``mean + std * z(prob)`` with std n-1.
    """
    from statloom.operators.describe import moments
    cols = cols or numeric_columns(df)
    probs = [i / (points + 1) for i in range(1, points + 1)]
    z = {p: norm_ppf(p) for p in probs}
    m = moments(df, cols)
    from statloom.functions.ranks import exact_quantiles
    sq = exact_quantiles(df, cols, probs, max_group_cells=float(max(
        [r["count"] for r in m.select("count").collect()] or [0])))
    zt = df.sparkSession.createDataFrame([(float(p), float(z[p])) for p in probs], "prob double, z double")
    return (sq.join(F.broadcast(zt), "prob").join(F.broadcast(m.select("column_name", "mean", "std")), "column_name")
            .select("column_name", "prob", F.col("q").alias("sample_q"),
                    (F.col("mean") + F.col("std") * F.col("z")).alias("normal_q")))
