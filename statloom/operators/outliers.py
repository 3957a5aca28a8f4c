"""Outlier detection (O1 IQR fences, O2 z-score, O3 isolation forest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.exprs import clean_numeric, numeric_columns, stack_long
from statloom.functions.ranks import quantile_wide

IQR_K = 1.5
Z_LIMIT = 3.0
FIRST_KEYS = 10


def _first_keys(flagged: DataFrame, key: str, k: int, by: list[str] | None = None) -> DataFrame:
    """Smallest ``k`` keys per column (and segment) as a comma list (partial top-k per task)."""
    group = ["column_name", *(by or [])]
    w = Window.partitionBy(*group).orderBy(key)
    top = flagged.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return top.groupBy(*group).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.col(key))),
                                 lambda v: v.cast("string")), ",").alias("first_keys"))


def _joined(long: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their column's statistics; one row per column is broadcast, segments are left to AQE."""
    return long.join(stats, ["column_name", *by]) if by else long.join(F.broadcast(stats), "column_name")


def outliers_iqr(df: DataFrame, key: str, cols: list[str] | None = None, k: float = IQR_K,
                 first: int = FIRST_KEYS, by: list[str] | None = None) -> DataFrame:
    """O1: values strictly outside ``[q1 - k iqr, q3 + k iqr]``, per segment of ``by`` if given.

    ``pct`` is relative to all rows (of the segment, as the reference does);
    ``first_keys`` lists the smallest ``first`` keys of flagged rows.
    """
    by = by or []
    cols = cols or [c for c in numeric_columns(df) if c != key and c not in by]
    x = clean_numeric(df, cols, keep=[key, *by])
    q = quantile_wide(x, cols, [0.25, 0.75], ["q1", "q3"], by=by)
    fences = q.select("column_name", *by, "q1", "q3",
                      (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
                      (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"))
    long = stack_long(x, cols, keep=[key, *by])
    flagged = _joined(long, fences, by).filter((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    counts = flagged.groupBy("column_name", *by).agg(F.count(F.lit(1)).alias("count"))
    keys = ["column_name", *by]
    out = fences.join(counts, keys, "left").join(_first_keys(flagged, key, first, by), keys, "left")
    if by:
        out = out.join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")), by)
        rows = F.col("_rows")
    else:
        rows = F.lit(df.count())
    return out.select("column_name", *by, "q1", "q3", "lower", "upper",
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                      F.try_divide(F.coalesce("count", F.lit(0)) * 100.0, rows).alias("pct"),
                      F.coalesce("first_keys", F.lit("")).alias("first_keys"))


def outliers_zscore(df: DataFrame, key: str, cols: list[str] | None = None,
                    limit: float = Z_LIMIT, first: int = FIRST_KEYS, by: list[str] | None = None) -> DataFrame:
    """O2: ``|x - mean| / std_pop > 3``; ``pct`` relative to non-null rows."""
    by = by or []
    cols = cols or [c for c in numeric_columns(df) if c != key and c not in by]
    x = clean_numeric(df, cols, keep=[key, *by])
    long = stack_long(x, cols, keep=[key, *by])
    keys = ["column_name", *by]
    st = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                 F.count(F.lit(1)).alias("n"))
    z = F.abs(F.try_divide(F.col("value") - F.col("mean"), F.col("std")))  # null for a constant column
    flagged = _joined(long, st, by).filter((F.col("std") > 0) & (z > limit))
    counts = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    out = st.join(counts, keys, "left").join(_first_keys(flagged, key, first, by), keys, "left")
    return out.select("column_name", *by, "mean", "std",
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"),
                      (F.coalesce("count", F.lit(0)) * 100.0 / F.col("n")).alias("pct"),
                      F.coalesce("first_keys", F.lit("")).alias("first_keys"))
