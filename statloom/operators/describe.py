"""Descriptive statistics.

One wide hash aggregate computes every moment of every column in a single
scan (partial aggregation map-side, one tiny final row); quantiles come from
the distributed exact-quantile primitive; categorical statistics come from a
value-count aggregate over the unpivoted string columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.exprs import (adjusted_kurt, adjusted_skew, clean_numeric, explode_structs,
                                      num, numeric_columns, safe_div, stack_long,
                                      string_columns)
from statloom.functions.ranks import quantile_wide
from statloom.session import ensure_parallelism

FULL_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
FULL_NAMES = ["p01", "p05", "p25", "p50", "p75", "p95", "p99"]


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, count, nulls, rows, mean, std, var, min, max, skew, kurt)``.

    ``std``/``var`` use n-1, ``skew``/``kurt`` are the sample-adjusted G1/G2
    (pandas semantics).  Two scans of plain sums instead of one scan of
    central-moment aggregates: pass 1 gets count, sum, min and max; pass 2
    gets the centred power sums around the pass-1 means (passed as literals,
    schema-sized).  The shifted formulas keep full precision and both passes
    are small, fully code-generated aggregates.
    """
    x = clean_numeric(df, cols)
    p1 = x.agg(F.count(F.lit(1)).alias("_rows"),
               *[a for i, c in enumerate(cols) for a in (
                   F.count(c).alias(f"n{i}"), F.sum(c).alias(f"s{i}"),
                   F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
    rows = p1["_rows"]
    shift = [(p1[f"s{i}"] / p1[f"n{i}"]) if p1[f"n{i}"] else 0.0 for i in range(len(cols))]
    aggs = []
    for i, c in enumerate(cols):
        d = F.col(c) - F.lit(float(shift[i]))
        aggs += [F.sum(d).alias(f"a{i}"), F.sum(d * d).alias(f"b{i}"),
                 F.sum(d * d * d).alias(f"c{i}"), F.sum(d * d * d * d).alias(f"e{i}")]
    p2 = x.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        n = p1[f"n{i}"]
        s1, s2, s3, s4 = (p2[f"{k}{i}"] for k in "abce")
        rec = dict(column_name=c, count=n, nulls=rows - n, rows=rows,
                   mean=None, std=None, var=None, min=p1[f"lo{i}"], max=p1[f"hi{i}"],
                   skew=None, kurt=None)
        if n:
            dm = s1 / n
            rec["mean"] = shift[i] + dm
            m2 = max(s2 / n - dm * dm, 0.0)
            m3 = s3 / n - 3 * dm * s2 / n + 2 * dm ** 3
            m4 = s4 / n - 4 * dm * s3 / n + 6 * dm * dm * s2 / n - 3 * dm ** 4
            if n > 1:
                rec["var"] = m2 * n / (n - 1)
                rec["std"] = rec["var"] ** 0.5
            if n > 2:
                rec["skew"] = 0.0 if m2 == 0 else (m3 / m2 ** 1.5) * (n * (n - 1)) ** 0.5 / (n - 2)
            if n > 3:
                rec["kurt"] = 0.0 if m2 == 0 else (
                    (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (m4 / (m2 * m2) - 3) + 6))
        out.append(rec)
    return df.sparkSession.createDataFrame(out, schema=MOMENTS_SCHEMA)


MOMENTS_SCHEMA = ("column_name string, count long, nulls long, rows long, mean double, "
                  "std double, var double, min double, max double, skew double, kurt double")


def _cells(m: DataFrame) -> float:
    """Upper bound on the cells of the largest column: its non-null values."""
    return float(max([r["count"] for r in m.select("count").collect()] or [0]))


def describe_full(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per numeric column with moments, 7 percentiles and spreads."""
    cols = cols or numeric_columns(df)
    m = moments(df, cols)
    q = quantile_wide(df, cols, FULL_PROBS, FULL_NAMES, max_group_cells=_cells(m))
    j = m.join(F.broadcast(q), "column_name", "left")  # both sides: one row per column
    return j.select(
        "column_name", "count", "mean", "std", "min", *FULL_NAMES, "max", "var",
        "skew", "kurt",
        (F.col("p75") - F.col("p25")).alias("iqr"),
        F.abs(safe_div(F.col("std"), F.col("mean"))).alias("cv"),
        (F.col("max") - F.col("min")).alias("range"),
        "nulls",
        (safe_div(F.col("nulls"), F.col("rows")) * 100.0).alias("pct_nulls"))


def describe_numeric(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Pandas ``describe``: count, mean, std, min, 25/50/75 %, max; per segment of ``by`` if given."""
    cols = cols or [c for c in numeric_columns(df) if c not in (by or [])]
    if by:
        keys = ["column_name", *by]
        long = stack_long(clean_numeric(df, cols, keep=by), cols, keep=by)
        m = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
        q = quantile_wide(df, cols, [0.25, 0.5, 0.75], ["p25", "p50", "p75"], by=by)
        return m.join(q, keys).select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")
    m = moments(df, cols)
    q = quantile_wide(df, cols, [0.25, 0.5, 0.75], ["p25", "p50", "p75"], max_group_cells=_cells(m))
    return (m.join(F.broadcast(q), "column_name", "left")
            .select("column_name", "count", "mean", "std", "min", "p25", "p50",
                    "p75", "max"))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(column_name, value, cnt)`` over non-null string values (map-side combined)."""
    long = stack_long(ensure_parallelism(df), cols, value_type="string")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _categorical_core(df: DataFrame, cols: list[str]) -> DataFrame:
    vc = value_counts(df, cols)
    per_col = vc.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("cnt").alias("non_null"),
        # mode: highest count, ties broken by the smallest value
        F.min_by("value", F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("v"))).alias("mode"),
        F.max("cnt").alias("mode_freq"),
        F.sum(F.col("cnt") * F.log(F.col("cnt"))).alias("_clnc"))
    return per_col


def describe_categorical_by(df: DataFrame, by: list[str], cols: list[str] | None = None) -> DataFrame:
    """D2 per segment ``by``: one row per segment and column, from one count per (segment, column, value)."""
    cols = cols or [c for c in string_columns(df) if c not in by]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])
    vc = ensure_parallelism(df).select(*by, F.inline(pairs)).groupBy(*by, "column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    has = F.col("value").isNotNull()
    cnt = F.when(has, F.col("cnt"))
    g = vc.groupBy(*by, "column_name").agg(
        F.count("value").alias("n_distinct"), F.sum("cnt").alias("_rows"), F.sum(cnt).alias("_nn"),
        F.min_by("value", F.when(has, F.struct((-F.col("cnt")).alias("c"), F.col("value").alias("v")))).alias("mode"),
        F.coalesce(F.max(cnt), F.lit(0)).alias("mode_freq"), F.sum(cnt * F.log(cnt)).alias("_clnc"))
    nn = F.col("_nn").cast("double")
    return g.select(*by, "column_name", "n_distinct", "mode", "mode_freq", (F.col("mode_freq") * 100.0 / F.col("_rows")).alias("mode_pct"),
                    (F.log(nn) - F.col("_clnc") / nn).alias("entropy"), (F.col("_rows") - F.coalesce("_nn", F.lit(0))).alias("nulls"),
                    ((F.col("_rows") - F.coalesce("_nn", F.lit(0))) * 100.0 / F.col("_rows")).alias("pct_nulls"))


def describe_categorical(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Distinct, mode, mode freq, mode %, entropy (ln), nulls, % nulls; with ``by``, per segment."""
    if by:
        return describe_categorical_by(df, by, cols)
    cols = cols or string_columns(df)
    rows = df.agg(F.count(F.lit(1)).alias("rows"),
                  *[F.count(c).alias(f"nn{i}") for i, c in enumerate(cols)])
    nn = explode_structs(rows, [F.struct(F.lit(c).alias("column_name"),
                                         F.col("rows").alias("rows"),
                                         (F.col("rows") - F.col(f"nn{i}")).alias("nulls"))
                                for i, c in enumerate(cols)])
    core = _categorical_core(df, cols)
    j = nn.join(core, "column_name", "left")
    nnul = F.col("non_null").cast("double")
    return j.select(
        "column_name",
        F.coalesce(F.col("n_distinct"), F.lit(0)).cast("long").alias("n_distinct"),
        "mode",
        F.coalesce(F.col("mode_freq"), F.lit(0)).cast("long").alias("mode_freq"),
        F.coalesce(safe_div(F.col("mode_freq"), F.col("rows")) * 100.0, F.lit(0.0)).alias("mode_pct"),
        (F.log(nnul) - F.col("_clnc") / nnul).alias("entropy"),
        F.col("nulls").cast("long").alias("nulls"),
        (safe_div(F.col("nulls"), F.col("rows")) * 100.0).alias("pct_nulls"))


def categorical_top(df: DataFrame, cols: list[str] | None = None, limit_cols: int = 10) -> DataFrame:
    """Top value and its frequency for the first ``limit_cols`` text columns."""
    cols = (cols or string_columns(df))[:limit_cols]
    core = _categorical_core(df, cols)
    return core.select("column_name", F.col("n_distinct").cast("long").alias("n_distinct"),
                       F.col("mode").alias("top"), F.col("mode_freq").cast("long").alias("freq"))


def top_values(df: DataFrame, cols: list[str], k: int = 10) -> DataFrame:
    """Top-``k`` values per column by count (ties by value); partial top-k per task."""
    vc = value_counts(df, cols)
    w = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc("value"))
    return vc.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
