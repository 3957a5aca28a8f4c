"""Chart data frames (G1, G6, G7); G2 lives in ``correlate``, G3/G5 in
``multivariate``, G4 in ``timeseries``.  Frames only: drawing is the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.exprs import clean_numeric, numeric_columns, stack_long
from statloom.functions.ranks import quantile_wide
from statloom.session import ensure_parallelism

MAX_BINS = 30
HIST_COLS = 6


def histogram_bins(df: DataFrame, cols: list[str] | None = None, bins: int = MAX_BINS) -> DataFrame:
    """G1: equal-width bins between min and max: ``(column_name, bin, lower, upper, count)``.

    The last bin is closed on the right; a constant column fills bin 0.
    """
    cols = cols or numeric_columns(df)[:HIST_COLS]
    long = stack_long(clean_numeric(ensure_parallelism(df), cols), cols)
    rng = long.groupBy("column_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    b = F.when(w > 0, F.least(F.floor((F.col("value") - F.col("lo")) / w), F.lit(bins - 1))
               ).otherwise(F.lit(0)).cast("int")
    counted = (long.join(F.broadcast(rng), "column_name")  # one row per column
               .groupBy("column_name", b.alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("count")))
    return counted.select("column_name", "bin",
                          (F.col("lo") + F.col("bin") * w).alias("lower"),
                          (F.col("lo") + (F.col("bin") + 1) * w).alias("upper"), "count")


def chart_bar(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """G6 bar: ``sum(y)`` per x (and colour)."""
    keys = [x] + ([color] if color else [])
    return df.groupBy(*keys).agg(F.sum(y).alias("y_sum"), F.count(F.lit(1)).alias("n"))


def chart_line(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """G6 line: mean of y per x (and colour), ordered by x at display time."""
    keys = [x] + ([color] if color else [])
    return df.groupBy(*keys).agg(F.avg(y).alias("y_mean"), F.count(F.lit(1)).alias("n"))


def chart_scatter(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """G6 scatter: every point with both coordinates, equal points as one row with their count."""
    keys = [x, y] + ([color] if color else [])
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def chart_box(df: DataFrame, y: str, by: str | None = None) -> DataFrame:
    """G6 box: quartiles, whiskers at the extreme points inside 1.5 IQR, outlier count."""
    by_cols = [by] if by else []
    x = clean_numeric(df, [y], keep=by_cols)
    q = quantile_wide(x, [y], [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=by_cols)
    j = stack_long(x, [y], keep=by_cols).join(q, ["column_name", *by_cols])
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    return j.groupBy(*by_cols, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))


def chart_violin(df: DataFrame, y: str, by: str | None = None, bins: int = 50) -> DataFrame:
    """G6 violin: binned density per group, ``density = count / (n * width)``."""
    x = clean_numeric(df, [y], keep=[by] if by else []).filter(F.col(y).isNotNull())
    if not by:
        x = x.withColumn("_all", F.lit(0))
    by_cols = [by or "_all"]
    rng = x.groupBy(*by_cols).agg(F.min(y).alias("lo"), F.max(y).alias("hi"),
                                  F.count(F.lit(1)).alias("n"))
    # one row per group: broadcast when AQE sees it is small, shuffle otherwise
    j = x.join(rng, by_cols)
    w = (F.col("hi") - F.col("lo")) / bins
    b = F.when(w > 0, F.least(F.floor((F.col(y) - F.col("lo")) / w), F.lit(bins - 1))
               ).otherwise(F.lit(0)).cast("int")
    c = j.groupBy(*by_cols, b.alias("bin"), "lo", "hi", "n").agg(F.count(F.lit(1)).alias("count"))
    return c.select(*([by] if by else []), "bin", (F.col("lo") + (F.col("bin") + 0.5) * w).alias("center"),
                    "count",
                    F.when(w > 0, F.col("count") / (F.col("n") * w)).alias("density"))


def chart_pie(df: DataFrame, label: str, value: str | None = None) -> DataFrame:
    """G7 pie: total per label and its share of the grand total."""
    v = F.sum(value) if value else F.count(F.lit(1))
    g = df.groupBy(label).agg(v.cast("double").alias("total"))
    grand = df.agg(v.cast("double")).first()[0]  # one scalar
    return g.select(label, "total", F.try_divide(F.col("total"), F.lit(grand)).alias("share"))
