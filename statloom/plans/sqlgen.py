"""Small SQL text generators for the DuckDB oracles (one SELECT per column)."""

from __future__ import annotations


def describe_full_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        x = "x"
        parts.append(
            f"SELECT '{c}' AS column_name, count({x}) AS count, avg({x}) AS mean, "
            f"stddev_samp({x}) AS std, min({x}) AS min, "
            + ", ".join(f"quantile_cont({x}, {p}) AS {nm}" for p, nm in
                        zip([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99],
                            ["p01", "p05", "p25", "p50", "p75", "p95", "p99"]))
            + f", max({x}) AS max, var_samp({x}) AS var, skewness({x}) AS skew, "
            f"kurtosis({x}) AS kurt, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr, "
            f"abs(stddev_samp({x}) / avg({x})) AS cv, max({x}) - min({x}) AS range, "
            f"count(*) - count({x}) AS nulls, (count(*) - count({x})) * 100.0 / count(*) AS pct_nulls "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src})")
    return "\nUNION ALL\n".join(parts)


def describe_numeric_sql(src: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS column_name, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std, "
            f"min(x) AS min, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, "
            f"quantile_cont(x, 0.75) AS p75, max(x) AS max FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {src})")
    return "\nUNION ALL\n".join(parts)


def value_counts_sql(src: str, cols: list[str]) -> str:
    """``vc(column_name, value, cnt)`` over non-null values, as a subquery body."""
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS cnt "
        f"FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)


def describe_categorical_sql(src: str, cols: list[str]) -> str:
    rows = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls FROM {src}"
        for c in cols)
    return f"""WITH vc AS ({value_counts_sql(src, cols)}),
core AS (SELECT column_name, count(*) AS n_distinct, sum(cnt) AS non_null,
   arg_min(value, (-cnt, value)) AS mode, max(cnt) AS mode_freq,
   sum(cnt * ln(cnt)) AS clnc FROM vc GROUP BY column_name),
nn AS ({rows})
SELECT nn.column_name, CAST(coalesce(n_distinct, 0) AS BIGINT) AS n_distinct, mode,
  CAST(coalesce(mode_freq, 0) AS BIGINT) AS mode_freq,
  coalesce(mode_freq * 100.0 / rows, 0.0) AS mode_pct,
  ln(CAST(non_null AS DOUBLE)) - clnc / non_null AS entropy,
  CAST(nulls AS BIGINT) AS nulls, nulls * 100.0 / rows AS pct_nulls
FROM nn LEFT JOIN core USING (column_name)"""


def categorical_top_sql(src: str, cols: list[str]) -> str:
    return f"""WITH vc AS ({value_counts_sql(src, cols)})
SELECT column_name, CAST(count(*) AS BIGINT) AS n_distinct, arg_min(value, (-cnt, value)) AS top,
  CAST(max(cnt) AS BIGINT) AS freq FROM vc GROUP BY column_name"""
