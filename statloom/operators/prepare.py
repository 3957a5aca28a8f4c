"""Cleaning and feature derivation.

Each transform is a projection over the whole table after at most one small
profiling aggregation; decisions (which columns get which feature) are taken
on schema-sized results, then applied in a single ``select``.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.exprs import nan_to_null, clean_numeric, numeric_columns, string_columns
from statloom.functions.ranks import quantile_wide
from statloom.session import ensure_checkpoint_dir

# Fixed values that must equal the reference's behaviour.
MISSING_LABEL = "mancante"   # label given to nulls before binary encoding
IMPUTE_MAX_SHARE = 0.5       # impute only when 0 < null share <= this
DROP_MIN_SHARE = 0.95        # drop columns with null share above this
SKEW_LIMIT = 1.0
ONE_HOT_MAX_LEVELS = 10
SAMPLE_SEED = 42
SAMPLE_SIZE = 10000

DATETIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy",
                    "dd/MM/yyyy", "yyyy-MM-dd'T'HH:mm:ss"]


def _null_shares(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Null share per column (one aggregation, schema-sized collect)."""
    if not cols:
        return {}
    r = nan_to_null(df).agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    n = r["_n"] or 0
    return {c: ((n - r[f"c{i}"]) / n if n else 0.0) for i, c in enumerate(cols)}


def sample_n(df: DataFrame, key: str, n: int = SAMPLE_SIZE, seed: int = SAMPLE_SEED) -> DataFrame:
    """Deterministic exact-size sample when the table has more than ``n`` rows.

    Rows are ordered by ``md5(seed || key)`` (ties by key) and the first ``n``
    kept.  A hash threshold a little above the share ``n / rows`` leaves about
    ``n`` rows before the merge, however many tasks there are; should too few
    pass it, the whole table is ordered.  Returns the table unchanged when it
    is small.
    """
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.count()
    if rows <= n:
        return df
    share = (n + 8 * n ** 0.5 + 20) / rows
    low = df.filter(F.conv(F.substring(h, 1, 8), 16, 10).cast("long") < F.lit(int(share * 2 ** 32)))
    few = low if share < 1 and low.count() >= n else df
    return few.orderBy(h, F.col(key)).limit(n)


def impute_median(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric nulls -> exact median when 0 < null share <= 0.5."""
    cols = cols or numeric_columns(df)
    shares = _null_shares(df, cols)
    todo = [c for c in cols if 0 < shares[c] <= IMPUTE_MAX_SHARE]
    if not todo:
        return df
    med = {r["column_name"]: r["median"] for r in
           quantile_wide(df, todo, [0.5], ["median"]).collect()}  # one row per column
    x = clean_numeric(df, todo, keep=[c for c in df.columns if c not in todo]).select(*df.columns)
    return x.withColumns({c: F.coalesce(F.col(c), F.lit(med[c])) for c in todo})


def mode_values(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, ties -> smallest (schema-sized)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                                 F.col(c).cast("string").alias("value"))
                                        for c in cols]))).filter(F.col("value").isNotNull())
    vc = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    m = vc.groupBy("column_name").agg(F.min_by("value", F.struct((-F.col("cnt")).alias("c"),
                                                                  F.col("value").alias("v"))).alias("mode"))
    return {r[0]: r[1] for r in m.collect()}


def impute_mode(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """text/category nulls -> mode when 0 < null share <= 0.5."""
    cols = cols or string_columns(df)
    shares = _null_shares(df, cols)
    todo = [c for c in cols if 0 < shares[c] <= IMPUTE_MAX_SHARE]
    if not todo:
        return df
    modes = mode_values(df, todo)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(modes.get(c))) for c in todo})


def fill_ffill_bfill(df: DataFrame, col: str, order: list[str],
                     partition: list[str] | None = None) -> DataFrame:
    """C4: forward fill then backward fill ``col`` along ``order``.

    With a ``partition`` key it is a pair of windows.  Without one, the table
    is range-partitioned on ``order`` (lineage cut by a reliable checkpoint so
    the bounds are stable), each range fills locally, and the value carried
    across ranges comes from a table of one row per range partition.
    """
    # The backward fill is a forward fill over the reversed order: a growing
    # frame is linear, while CURRENT ROW .. UNBOUNDED FOLLOWING re-aggregates
    # the remaining rows for every row.
    desc = [F.col(c).desc() for c in order]
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        wr = Window.partitionBy(*partition).orderBy(*desc)
        f = F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        b = F.last(col, ignorenulls=True).over(wr.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn("_f", f).withColumn("_b", b).withColumn(
            col, F.coalesce("_f", "_b")).drop("_f", "_b")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumn("_pid", F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)
    w = Window.partitionBy("_pid").orderBy(*order)
    wr = Window.partitionBy("_pid").orderBy(*desc)
    local = ranged.withColumn("_f", F.last(col, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "_b", F.last(col, ignorenulls=True).over(wr.rowsBetween(Window.unboundedPreceding, 0)))
    okey = F.struct(*order)
    edges = ranged.filter(F.col(col).isNotNull()).groupBy("_pid").agg(
        F.max_by(col, okey).alias("_last"), F.min_by(col, okey).alias("_first"))
    wp = Window.orderBy("_pid")  # one row per range partition
    wpr = Window.orderBy(F.col("_pid").desc())
    allp = ranged.select("_pid").distinct().join(edges, "_pid", "left")
    carry = allp.select(
        "_pid", "_first",
        F.last("_last", ignorenulls=True).over(wp.rowsBetween(Window.unboundedPreceding, -1)).alias("_cf"))
    carry = carry.select(
        "_pid", "_cf",
        F.last("_first", ignorenulls=True).over(wpr.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"))
    j = local.join(F.broadcast(carry), "_pid", "left")  # at most one row per partition
    filled = F.coalesce(F.col("_f"), F.col("_cf"), F.col("_b"), F.col("_cb"))
    return j.withColumn(col, filled).drop("_pid", "_f", "_b", "_cf", "_cb")


def drop_sparse_columns(df: DataFrame, threshold: float = DROP_MIN_SHARE) -> DataFrame:
    """Drop columns whose null share is above ``threshold``."""
    shares = _null_shares(df, df.columns)
    return df.drop(*[c for c in df.columns if shares[c] > threshold])


def parse_datetime_expr(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.try_to_timestamp(s), *[F.try_to_timestamp(s, F.lit(f)) for f in DATETIME_FORMATS])


def parse_datetime(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text -> timestamp, failures to null.

    One format per column: the one that reads most of its values (ISO text
    first, month before day on ties), so slash dates are never read both ways.
    """
    if not cols:
        return df
    every = [None, *DATETIME_FORMATS]

    def read(c, fmt):
        s = F.col(c).cast("string")
        return F.try_to_timestamp(s) if fmt is None else F.try_to_timestamp(s, F.lit(fmt))

    r = df.agg(*[F.count(read(c, f)).alias(f"n{i}_{j}") for i, c in enumerate(cols) for j, f in enumerate(every)]).first()
    best = {c: max(range(len(every)), key=lambda j: (r[f"n{i}_{j}"], -j)) for i, c in enumerate(cols)}
    return df.withColumns({c: read(c, every[j]) for c, j in best.items()})


def datetime_features(df: DataFrame, col: str, parse: bool = False) -> DataFrame:
    """Year, month, quarter, day, weekday (Mon=0), weekend flag, whole days since min.

    One profiling aggregation without a distinct count decides which features exist: years
    differ when the ends' do, months are a set of bits, and more than seven values are
    sure above a sketch of 20 (counted exactly below); ``days_since`` varies exactly
    when the span is at least one day.
    """
    if parse:
        df = parse_datetime(df, [col])
    c = F.col(col)
    months = F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), F.month(c))))
    p = df.agg(F.approx_count_distinct(c).alias("dd"), F.year(F.min(c)).alias("y0"), F.year(F.max(c)).alias("y1"),
               months.alias("dm"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count(c).alias("nn")).first()
    if not p["nn"] or p["lo"] == p["hi"]:
        return df
    distinct = p["dd"] if p["dd"] > 20 else df.select(c).where(c.isNotNull()).distinct().count()
    feats = {}
    if p["y0"] != p["y1"]:
        feats[f"{col}_year"] = F.year(c)
    if p["dm"] > 1:
        feats[f"{col}_month"] = F.month(c)
        feats[f"{col}_quarter"] = F.quarter(c)
    if distinct > 7:
        feats[f"{col}_day"] = F.dayofmonth(c)
        feats[f"{col}_weekday"] = F.weekday(c)
        feats[f"{col}_is_weekend"] = F.weekday(c).isin(5, 6).cast("int")
    if (p["hi"] - p["lo"]).total_seconds() >= 86400:
        lo = F.lit(p["lo"]).cast(df.schema[col].dataType)
        feats[f"{col}_days_since"] = F.timestamp_diff("DAY", lo, c)
    return df.withColumns(feats)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text -> double, failures to null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def skew_transform(df: DataFrame, cols: list[str] | None = None, limit: float = SKEW_LIMIT) -> DataFrame:
    """``log1p`` (all > 0) or ``sqrt`` (all >= 0) when |adjusted skew| > 1.

    A null anywhere in the column blocks both (the reference's ``all`` over
    values with NaN), matching its behaviour.
    """
    from statloom.operators.describe import moments
    cols = cols or numeric_columns(df)
    m = {r["column_name"]: r for r in moments(df, cols).collect()}
    feats = {}
    for c in cols:
        r = m[c]
        if r["count"] and r["skew"] is not None and abs(r["skew"]) > limit and r["nulls"] == 0:
            if r["min"] > 0:
                feats[f"{c}_log"] = F.log1p(F.col(c).cast("double"))
            elif r["min"] >= 0:
                feats[f"{c}_sqrt"] = F.sqrt(F.col(c).cast("double"))
    return df.withColumns(feats) if feats else df


def _levels(df: DataFrame, col: str, limit: int) -> list | None:
    """Sorted distinct non-null levels when there are at most ``limit`` (else None)."""
    d = df.filter(F.col(col).isNotNull()).select(col).distinct().limit(limit + 1).collect()
    if len(d) > limit:
        return None
    return sorted(r[0] for r in d)


def label_encode_binary(df: DataFrame, col: str) -> DataFrame:
    """C11: exactly two levels -> sorted class index; nulls become a third class."""
    lv = _levels(df.select(F.col(col).cast("string").alias(col)), col, 2)
    if lv is None or len(lv) != 2:
        return df
    has_null = df.filter(F.col(col).isNull()).limit(1).count() > 0
    classes = sorted(lv + ([MISSING_LABEL] if has_null else []))
    v = F.coalesce(F.col(col).cast("string"), F.lit(MISSING_LABEL))
    e = None
    for i, lvl in enumerate(classes):
        e = (F.when(v == lvl, F.lit(i)) if e is None else e.when(v == lvl, F.lit(i)))
    return df.withColumn(f"{col}_encoded", e.cast("long"))


def one_hot(df: DataFrame, col: str, max_levels: int = ONE_HOT_MAX_LEVELS) -> DataFrame:
    """3..9 levels -> boolean indicator per level except the first (sorted)."""
    lv = _levels(df, col, max_levels - 1)
    if lv is None or len(lv) == 2:
        return df
    return df.withColumns({f"{col}_{x}": F.coalesce(F.col(col) == F.lit(x), F.lit(False))
                           for x in lv[1:]})


def freq_encode(df: DataFrame, col: str) -> DataFrame:
    """Value -> its count / all rows (null stays null)."""
    from statloom.operators.encode import join_levels
    counts = df.groupBy(F.col(col).alias("level")).agg(F.count(F.lit(1)).alias("rows"))
    rows = df.count()
    counts = counts.filter("level IS NOT NULL").withColumn(f"{col}_freq", F.col("rows") / F.lit(float(rows)))
    out = join_levels(df, counts, {col: "level"})
    return out.select(col, *[c for c in out.columns if c != col])


def categorical_features(df: DataFrame, col: str) -> DataFrame:
    """C11-C13 dispatch on the number of levels."""
    lv = _levels(df, col, ONE_HOT_MAX_LEVELS - 1)
    if lv is not None and len(lv) == 2:
        return label_encode_binary(df, col)
    if lv is not None:
        return one_hot(df, col)
    return freq_encode(df, col)


def text_features(df: DataFrame, col: str) -> DataFrame:
    """C14: characters and whitespace-separated words (null as '')."""
    t = F.coalesce(F.col(col), F.lit(""))
    tr = F.trim(F.regexp_replace(t, r"\s+", " "))
    words = F.when(tr == "", F.lit(0)).otherwise(F.size(F.split(tr, " ")))
    return df.withColumns({f"{col}_n_chars": F.length(t), f"{col}_n_words": words.cast("int")})


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    """C17: rows with every listed column present (NaN counts as missing)."""
    cond = None
    for c in cols:
        ok = F.col(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
            ok = ok & ~F.isnan(c)
        cond = ok if cond is None else cond & ok
    return df.filter(cond)


def standardize(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """``(x - mean) / std_pop`` (constant columns become 0)."""
    x = clean_numeric(df, cols, keep=keep)
    st = x.agg(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    out = {}
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        out[c] = (F.col(c) - F.lit(m)) / F.lit(s) if s else F.col(c) * 0.0
    return x.withColumns(out)


def _humanize_batch(v: pd.Series, precision: int) -> pd.Series:
    def one(x):
        if x is None or x != x:
            return None
        if abs(x) >= 1e6:
            return f"{x / 1e6:.{precision}f}M"
        if abs(x) >= 1e3:
            return f"{x / 1e3:.{precision}f}K"
        return f"{x:.{precision}f}"
    return v.map(one)


def humanize_number(c: Column, precision: int = 2) -> Column:
    """``1.23M``, ``4.56K`` or plain with ``precision`` decimals.

    Formatting rounds the exact binary value half-to-even (as C and Python
    printf do); the JVM formatter rounds a shortest decimal half-up, which
    differs on values such as 249.845, so this small helper runs as an
    Arrow-batched pandas UDF.
    """
    @F.pandas_udf(T.StringType())
    def fmt(v: pd.Series) -> pd.Series:
        return _humanize_batch(v, precision)
    return fmt(c.cast("double"))


@dataclass(frozen=True)
class AnalysisParams:
    """Run parameters (the reference's ``context``/``ai_depth`` are LLM-only)."""
    analysis_types: tuple[str, ...] = ("descriptive", "correlations")
    advanced_analysis: tuple[str, ...] = ()
    confidence_level: float = 0.95
    use_sampling: bool = False
    sample_size: int = SAMPLE_SIZE
    max_series: int = 5


NUMERIC_CATEGORIES = ("numeric", "currency", "percent", "score")
CATEGORICAL_CATEGORIES = ("category", "boolean")


def preprocess(df: DataFrame, mapping: dict[str, str], params: AnalysisParams | None = None,
               key: str | None = None) -> DataFrame:
    """Sample -> impute -> per-category features -> drop sparse columns.

    ``mapping`` is ``column -> category`` (see ``profile.column_categories``).
    Datetime strings are parsed before imputation (the reference imputes them
    as text); derived columns keep English suffixes.
    """
    params = params or AnalysisParams()
    if params.use_sampling:
        if key is None:
            raise ValueError("sampling needs a key column")
        df = sample_n(df, key, params.sample_size)
    dt_text = [c for c, k in mapping.items() if k == "datetime" and c in df.columns
               and isinstance(df.schema[c].dataType, T.StringType)]
    if dt_text:
        df = parse_datetime(df, dt_text)
    nums = numeric_columns(df)
    df = impute_median(df, nums) if nums else df
    strs = string_columns(df)
    df = impute_mode(df, strs) if strs else df
    times = [f.name for f in df.schema.fields
             if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    if times and key:
        for c in times:
            shares = _null_shares(df, [c])
            if 0 < shares[c] <= IMPUTE_MAX_SHARE:
                df = fill_ffill_bfill(df, c, [key])
    mapping = {c: cat for c, cat in mapping.items() if c in df.columns}
    measures = [c for c, cat in mapping.items() if cat in NUMERIC_CATEGORIES]
    texts = [c for c in measures if isinstance(df.schema[c].dataType, T.StringType)]
    df = coerce_numeric(df, texts) if texts else df
    df = skew_transform(df, measures) if measures else df  # one profile for all
    for c, cat in mapping.items():
        if cat == "datetime":
            df = datetime_features(df, c)
        elif cat in CATEGORICAL_CATEGORIES:
            df = categorical_features(df, c)
        elif cat == "text":
            df = text_features(df, c)
    return drop_sparse_columns(df)
