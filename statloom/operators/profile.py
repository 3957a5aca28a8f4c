"""Profiling and schema discovery.

Everything is one or two aggregations over the whole table; the results are
schema-sized frames (one row per column).  Rules that decide a column's
category run as Catalyst ``when`` chains over that small frame.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.functions.exprs import nan_to_null, explode_structs, safe_div
from statloom.session import ensure_parallelism

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (semantic categories).
# Substring tests on the lower-cased column name, first matching rule wins.
DATETIME_WORDS = ["date", "data", "time", "tempo", "timestamp", "datetime", "created",
                  "creato", "updated", "aggiornato"]
CURRENCY_WORDS = ["cost", "costo", "price", "prezzo", "revenue", "ricavo", "amount",
                  "importo", "spend", "spesa", "budget", "entrate", "uscite", "euro",
                  "dollar", "usd", "eur", "payment", "pagamento", "fee", "tariffa", "charge"]
TARGET_WORDS = ["revenue", "ricavo", "entrate", "profit", "profitto", "income", "reddito",
                "sales", "vendite"]
PERCENT_WORDS = ["percent", "percentuale", "rate", "tasso", "ratio", "rapporto", "pct", "%"]
ID_WORDS = ["id", "key", "chiave", "code", "codice", "identifier", "identificatore"]
CATEGORY_WORDS = ["category", "categoria", "type", "tipo", "class", "classe", "group",
                  "gruppo", "status", "stato"]
SCORE_WORDS = ["score", "punteggio", "rating", "valutazione"]
ID_MIN_RATIO = 0.9
CATEGORY_MAX_RATIO = 0.05
TEXT_MIN_RATIO = 0.5
#: Most rows of a task that counts distinct values.
TASK_ROWS = 500_000
# ---------------------------------------------------------------------------

CATEGORIES = ["identifier", "datetime", "numeric", "category", "text", "target", "feature",
              "location", "currency", "percent", "score", "boolean", "other"]


def pandas_dtype(dt) -> str:
    """The dtype label a pandas reader would give this Spark type."""
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "float64"
    if isinstance(dt, T.BooleanType):
        return "bool"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime64[ns]"
    return "object"


def _width(dt) -> int | None:
    return {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4,
            T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8,
            T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}.get(type(dt))


def _schema_frame(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, pandas_dtype(f.dataType), f.dataType.simpleString())
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "ordinal int, column_name string, dtype string, spark_type string")


def dtype_counts(df: DataFrame) -> DataFrame:
    """``(dtype, n_columns)``: columns per physical type."""
    return _schema_frame(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


def table_shape(df: DataFrame) -> DataFrame:
    """``(n_rows, n_cols)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("long").alias("n_cols"))


def missing_profile(df: DataFrame, nonzero_only: bool = False) -> DataFrame:
    """``(column_name, nulls, pct_nulls)``; NaN counts as missing."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def miss(c):
        m = F.col(c).isNull()
        if isinstance(types[c], (T.FloatType, T.DoubleType)):
            m = m | F.isnan(c)
        return F.sum(m.cast("long"))

    wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                  *[miss(c).alias(f"m{i}") for i, c in enumerate(df.columns)])
    out = explode_structs(wide, [F.struct(
        F.lit(c).alias("column_name"), F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("nulls"),
        F.coalesce(safe_div(F.col(f"m{i}"), F.col("_rows")) * 100.0, F.lit(0.0)).alias("pct_nulls"))
        for i, c in enumerate(df.columns)])
    return out.filter(F.col("nulls") > 0) if nonzero_only else out


def table_bytes(df: DataFrame) -> DataFrame:
    """P4 (re-aimed): estimated data bytes per column (fixed widths + UTF-8 bytes)."""
    aggs = []
    for i, f in enumerate(df.schema.fields):
        w = _width(f.dataType)
        if w is not None:
            aggs.append((F.count(f.name) * w).cast("long").alias(f"b{i}"))
        else:
            aggs.append(F.coalesce(F.sum(F.octet_length(F.col(f.name).cast("string"))),
                                   F.lit(0)).cast("long").alias(f"b{i}"))
    wide = df.agg(*aggs)
    return explode_structs(wide, [F.struct(F.lit(c).alias("column_name"), F.col(f"b{i}").alias("bytes"),
                                           (F.col(f"b{i}") / 1048576.0).alias("mb"))
                                  for i, c in enumerate(df.columns)])


def unique_ratio(df: DataFrame, exact: bool = True) -> DataFrame:
    """P5: ``(column_name, n_distinct, unique_ratio)``; nulls are not a value,
    the denominator is all rows.  ``exact=False`` uses HyperLogLog++."""
    dc = F.countDistinct if exact else F.approx_count_distinct
    wide = nan_to_null(ensure_parallelism(df)).agg(F.count(F.lit(1)).alias("_rows"),
                  *[dc(F.col(c)).alias(f"d{i}") for i, c in enumerate(df.columns)])
    return explode_structs(wide, [F.struct(
        F.lit(c).alias("column_name"), F.col(f"d{i}").cast("long").alias("n_distinct"),
        safe_div(F.col(f"d{i}"), F.col("_rows")).alias("unique_ratio"))
        for i, c in enumerate(df.columns)])


def _parse_ts(v):
    from statloom.operators.prepare import parse_datetime_expr
    return parse_datetime_expr(v)


def column_types(df: DataFrame, key: str, sample: int = 10) -> DataFrame:
    """Physical type per column.

    Strings whose first ``sample`` non-null values (ordered by ``key``) all
    parse as timestamps are ``datetime_string``; otherwise unique ratio < 5 %
    is ``categorical`` and the rest ``text``.  The first values come from a
    per-column top-k (Spark applies the limit per task before the shuffle).
    """
    fields = df.schema.fields
    strs = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    base = []
    for f in fields:
        dt = f.dataType
        if isinstance(dt, T.BooleanType):
            t = "boolean"
        elif isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            t = "integer"
        elif isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
            t = "float"
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            t = "datetime"
        elif isinstance(dt, T.StringType):
            t = None
        else:
            t = "text"
        base.append((f.name, t))
    spark = df.sparkSession
    fixed = spark.createDataFrame(base, "column_name string, base_type string")
    if not strs:
        return fixed.select("column_name", F.col("base_type").alias("physical_type"))
    ur = unique_ratio(df.select(*strs))
    long = df.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in strs])))
    long = long.filter(F.col("value").isNotNull())
    w = Window.partitionBy("column_name").orderBy(key)
    first = long.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample)
    parse = first.groupBy("column_name").agg(
        F.min(_parse_ts(F.col("value")).isNotNull().cast("int")).alias("_all_parse"))
    j = fixed.join(ur, "column_name", "left").join(parse, "column_name", "left")
    return j.select("column_name", F.coalesce(
        F.col("base_type"),
        F.when(F.col("_all_parse") == 1, F.lit("datetime_string"))
         .when(F.col("unique_ratio") < CATEGORY_MAX_RATIO, F.lit("categorical"))
         .otherwise(F.lit("text"))).alias("physical_type"))


def _has_any(name: str, words: list[str]):
    return F.lower(F.col(name)).rlike("|".join(re.escape(w) for w in words))


def category_rule(name="column_name", dtype="dtype", ratio="unique_ratio"):
    """P7 rule chain as a Catalyst expression over a profile frame."""
    r = F.col(ratio)
    d = F.col(dtype)
    return (F.when(_has_any(name, DATETIME_WORDS), F.lit("datetime"))
            .when(_has_any(name, CURRENCY_WORDS) & _has_any(name, TARGET_WORDS), F.lit("target"))
            .when(_has_any(name, CURRENCY_WORDS), F.lit("currency"))
            .when(_has_any(name, PERCENT_WORDS), F.lit("percent"))
            .when(_has_any(name, ID_WORDS) & (r > ID_MIN_RATIO), F.lit("identifier"))
            .when(d == "bool", F.lit("boolean"))
            .when((r < CATEGORY_MAX_RATIO) | _has_any(name, CATEGORY_WORDS), F.lit("category"))
            .when(d.contains("float") | d.contains("int"),
                  F.when(_has_any(name, SCORE_WORDS), F.lit("score")).otherwise(F.lit("numeric")))
            .when((d == "object") & (r > TEXT_MIN_RATIO), F.lit("text"))
            .otherwise(F.lit("other")))


def column_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Shared schema-sized profile: ordinal, name, dtype, distinct, ratio, nulls.

    One aggregation computes distinct counts and null counts together.
    """
    dc = F.countDistinct if exact else F.approx_count_distinct

    def miss(c):
        return F.sum(F.col(c).isNull().cast("long"))

    # a task groups the values of every column of its rows before the shuffle: its rows are bounded, whatever the table
    spread, parts = ensure_parallelism(df), -(-df.count() // TASK_ROWS)
    if parts > spread.rdd.getNumPartitions():
        spread = df.repartition(parts)
    wide = nan_to_null(spread).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[a for i, c in enumerate(df.columns) for a in (dc(F.col(c)).alias(f"d{i}"), miss(c).alias(f"m{i}"))])
    prof = explode_structs(wide, [F.struct(
        F.lit(c).alias("column_name"), F.col(f"d{i}").cast("long").alias("n_distinct"),
        safe_div(F.col(f"d{i}"), F.col("_rows")).alias("unique_ratio"),
        F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("nulls"),
        F.coalesce(safe_div(F.col(f"m{i}"), F.col("_rows")) * 100.0, F.lit(0.0)).alias("pct_nulls"))
        for i, c in enumerate(df.columns)])
    return _schema_frame(df).join(prof, "column_name")


def column_categories(df: DataFrame, exact: bool = True) -> DataFrame:
    """Suggested semantic category per column."""
    p = column_profile(df, exact)
    return p.select("column_name", "dtype", "unique_ratio", category_rule().alias("category"))


def column_digest(df: DataFrame, limit_cols: int = 20, exact: bool = True) -> DataFrame:
    """Dtype, category, distinct and % nulls for the first ``limit_cols`` columns."""
    sub = df.select(*df.columns[:limit_cols])
    p = column_profile(sub, exact)
    return p.select("ordinal", "column_name", "dtype", category_rule().alias("category"),
                    "n_distinct", "pct_nulls")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """P10: rows that repeat an earlier row (nulls compare equal)."""
    g = ensure_parallelism(df).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_rows"),
                 F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def validate_table(df: DataFrame) -> DataFrame:
    """``(level, rule, column_name)`` findings.

    error: empty table (and nothing else), duplicate column names; warning:
    more than 50 % missing; info: exactly one distinct non-null value, text
    column whose every non-null value is a number.
    """
    spark = df.sparkSession
    schema = "level string, rule string, column_name string"
    dup = sorted({c for c in df.columns if df.columns.count(c) > 1})
    fixed = [("error", "duplicate_columns", c) for c in dup]
    cols = [c for c in dict.fromkeys(df.columns)]
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    sel = df.select(*[F.col(f"`{c}`") for c in cols]) if not dup else df.toDF(
        *[f"_c{i}" for i in range(len(df.columns))])
    sel = nan_to_null(sel)
    names = cols if not dup else [f"_c{i}" for i in range(len(df.columns))]
    shown = cols if not dup else df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(names):
        # exactly one distinct non-null value <=> min == max: no distinct count needed
        aggs += [F.count(c).alias(f"n{i}"),
                 (F.min(c) == F.max(c)).cast("int").alias(f"d{i}")]
        if shown[i] in strs:
            aggs.append(F.sum((F.col(c).isNotNull() & F.col(c).try_cast("double").isNull())
                              .cast("long")).alias(f"t{i}"))
    wide = sel.agg(*aggs)
    found = []
    for i, c in enumerate(shown):
        rows, n, d = F.col("_rows"), F.col(f"n{i}"), F.col(f"d{i}")
        found.append(F.when((rows > 0) & ((rows - n) / rows > 0.5),
                            F.struct(F.lit("warning").alias("level"), F.lit("high_missing").alias("rule"),
                                     F.lit(c).alias("column_name"))))
        found.append(F.when((rows > 0) & (d == 1),
                            F.struct(F.lit("info").alias("level"), F.lit("constant").alias("rule"),
                                     F.lit(c).alias("column_name"))))
        if shown[i] in strs:
            found.append(F.when((rows > 0) & (F.coalesce(F.col(f"t{i}"), F.lit(0)) == 0),
                                F.struct(F.lit("info").alias("level"), F.lit("numeric_text").alias("rule"),
                                         F.lit(c).alias("column_name"))))
    empty = F.when(F.col("_rows") == 0, F.struct(F.lit("error").alias("level"),
                                                 F.lit("empty_table").alias("rule"),
                                                 F.lit(None).cast("string").alias("column_name")))
    rows_out = wide.select(F.when(F.col("_rows") == 0, F.array(empty)).otherwise(
        F.array(*found)).alias("_f"))
    res = rows_out.select(F.explode("_f").alias("_s")).filter(F.col("_s").isNotNull()).select("_s.*")
    if fixed:
        res = spark.createDataFrame(fixed, schema).unionByName(res)
    return res
