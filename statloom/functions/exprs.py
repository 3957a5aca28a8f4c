"""Column-expression helpers shared by all operators (all JVM-side, codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def num(c) -> Column:
    """Numeric value as double with NaN normalised to NULL (NaN == missing)."""
    x = col_of(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """The frame with NaN turned into NULL in its floating-point columns (one missing value, not two)."""
    cols = {f.name: F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)) for f in df.schema.fields
            if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.withColumns(cols) if cols else df


def sig_columns(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    """Round ``cols`` to ``digits`` significant digits (stable value hashing).

    Only exact powers of ten (non-negative exponents) and IEEE divide /
    multiply / add / floor are used, so Spark and the SQL twin
    :func:`sig_sql` produce bit-identical doubles.  Magnitudes below
    ``1e-12`` (numerical zeros such as the skew of a symmetric column) are 0.
    The expressions are SQL strings (one JVM call per stage, instead of one
    per operator node) in staged projections that keep generated code small.
    """
    if not cols:
        return df
    q = [f"`{c}`" for c in cols]
    keep = [f"`{c}`" for c in df.columns]
    s1 = df.selectExpr(*keep, *[f"CAST({c} AS DOUBLE) AS _sx{i}" for i, c in enumerate(q)])
    s1 = s1.selectExpr("*", *[f"CAST(FLOOR(LOG10(ABS(_sx{i}))) AS DOUBLE) AS _sk{i}" for i in range(len(q))])
    lead = "(CASE WHEN _sk{i} >= 0 THEN ABS(_sx{i}) / POW(10.0, _sk{i}) ELSE ABS(_sx{i}) * POW(10.0, -_sk{i}) END)"
    s2 = s1.selectExpr("*", *[
        f"({float(digits - 1)} - (_sk{i} + CASE WHEN {lead.format(i=i)} >= 10.0 THEN 1.0 "
        f"WHEN {lead.format(i=i)} < 1.0 THEN -1.0 ELSE 0.0 END)) AS _sm{i}" for i in range(len(q))])
    out = []
    pos = {c: i for i, c in enumerate(cols)}
    for c in df.columns:
        if c not in pos:
            out.append(f"`{c}`")
            continue
        i = pos[c]
        x, m = f"_sx{i}", f"_sm{i}"
        r = (f"(CASE WHEN {m} >= 0 THEN CAST(FLOOR({x} * POW(10.0, {m}) + 0.5) AS DOUBLE) / POW(10.0, {m}) "
             f"ELSE CAST(FLOOR({x} / POW(10.0, -{m}) + 0.5) AS DOUBLE) * POW(10.0, -{m}) END)")
        out.append(f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} WHEN ABS({x}) < 1e-12 THEN 0.0 "
                   f"ELSE {r} END + 0.0) AS `{c}`")
    return s2.selectExpr(*out)


def sig_sql(expr: str, digits: int = 9) -> str:
    """DuckDB twin of :func:`sig`."""
    x = f"CAST(({expr}) AS DOUBLE)"
    ax = f"abs({x})"
    k0 = f"floor(log10({ax}))"
    lead = f"(CASE WHEN {k0} >= 0 THEN {ax} / pow(10.0, {k0}) ELSE {ax} * pow(10.0, -{k0}) END)"
    k = f"({k0} + CASE WHEN {lead} >= 10.0 THEN 1.0 WHEN {lead} < 1.0 THEN -1.0 ELSE 0.0 END)"
    m = f"({float(digits - 1)} - {k})"
    r = (f"(CASE WHEN {m} >= 0 THEN floor({x} * pow(10.0, {m}) + 0.5) / pow(10.0, {m}) "
         f"ELSE floor({x} / pow(10.0, -{m}) + 0.5) * pow(10.0, -{m}) END)")
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} WHEN {ax} < 1e-12 THEN 0.0 "
            f"ELSE {r} END + 0.0)")


def is_numeric(dt) -> bool:
    return isinstance(dt, NUMERIC_TYPES) and not isinstance(dt, T.BooleanType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with a numeric type (booleans excluded, as in the reference)."""
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, TIME_TYPES)]


def adjusted_skew(g1: Column, n: Column) -> Column:
    """Sample-adjusted skewness G1 from the population g1 (pandas ``skew``).

    Constant columns give 0 (as pandas does), fewer than 3 values give NULL.
    """
    n = n.cast("double")
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(g1.isNull(), F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def adjusted_kurt(g2: Column, n: Column) -> Column:
    """Sample-adjusted excess kurtosis G2 from the population excess g2."""
    n = n.cast("double")
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(g2.isNull(), F.lit(0.0))
            .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


# Abramowitz & Stegun 26.2.17 (|error| < 7.5e-8); fixed published constants.
_AS_P = 0.2316419
_AS_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
_INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def norm_cdf(z: Column) -> Column:
    """Standard normal CDF as a Catalyst expression (no UDF)."""
    az = F.abs(z)
    t = 1.0 / (1.0 + _AS_P * az)
    poly = t * (_AS_B[0] + t * (_AS_B[1] + t * (_AS_B[2] + t * (_AS_B[3] + t * _AS_B[4]))))
    upper = F.lit(_INV_SQRT_2PI) * F.exp(-az * az / 2.0) * poly
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def norm_cdf_sql(z: str) -> str:
    """DuckDB twin of :func:`norm_cdf`."""
    b = _AS_B
    t = f"(1.0 / (1.0 + {_AS_P} * abs({z})))"
    poly = f"({t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]})))))"
    upper = f"({_INV_SQRT_2PI} * exp(-abs({z}) * abs({z}) / 2.0) * {poly})"
    return f"(CASE WHEN ({z}) >= 0 THEN 1.0 - {upper} ELSE {upper} END)"


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(None).cast("double")).otherwise(a.cast("double") / b)


def explode_structs(df: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row (or few-row) wide frame into long rows, one per struct."""
    if not structs:
        raise ValueError("nothing to explode")
    return df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")


def clean_numeric(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Project ``cols`` as doubles once (NaN -> NULL only where the type allows NaN)."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    out = []
    for c in cols:
        if isinstance(types.get(c), (T.FloatType, T.DoubleType)):
            out.append(num(c).alias(c))
        else:
            out.append(F.col(c).cast("double").alias(c))
    return df.select(*(keep or []), *out)


def stack_long(df: DataFrame, cols: list[str], value_type: str = "double",
               keep: list[str] | None = None, value_name: str = "value",
               drop_nulls: bool = True) -> DataFrame:
    """Unpivot ``cols`` to ``(keep..., column_name, value)`` with a Generate (narrow)."""
    keep = keep or []
    if value_type == "double":
        vals = [num(c) for c in cols]
    else:
        vals = [F.col(c).cast(value_type) for c in cols]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), v.alias(value_name))
                      for c, v in zip(cols, vals)])
    out = df.select(*keep, F.inline(pairs))
    if drop_nulls:
        out = out.filter(F.col(value_name).isNotNull())
    return out
