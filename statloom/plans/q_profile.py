"""Registered queries: profiling."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from statloom.operators import profile as P
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql

ORDERS_NULLS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                     "o_orderpriority", "mostly_null", "sparse"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"]
ORDERS_DTYPES = {"o_orderkey": "int64", "o_custkey": "int64", "o_orderstatus": "object",
                 "o_totalprice": "float64", "o_orderdate": "datetime64[ns]",
                 "o_orderpriority": "object", "mostly_null": "float64", "sparse": "float64"}


def _u(parts):
    return "\nUNION ALL\n".join(parts)


@register("table_shape", sql="SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def table_shape(spark, sf):
    return P.table_shape(frame(spark, sf, "lineitem"))


@register("missing_profile", sql=sql("orders_nulls") + _u([
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, "
    f"(count(*) - count({c})) * 100.0 / count(*) AS pct_nulls FROM orders_nulls"
    for c in ORDERS_NULLS_COLS]) + "\n) WHERE nulls > 0",
    sig_cols=["pct_nulls"])
def missing_profile(spark, sf):
    return P.missing_profile(frame(spark, sf, "orders_nulls"), nonzero_only=True)


# fix the SQL: wrap union so the WHERE applies to all branches
from statloom.plans.catalog import REGISTRY  # noqa: E402

REGISTRY["missing_profile"].sql = sql("orders_nulls") + "SELECT * FROM (" + _u([
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
    f"(count(*) - count({c})) * 100.0 / count(*) AS pct_nulls FROM orders_nulls"
    for c in ORDERS_NULLS_COLS]) + "\n) WHERE nulls > 0"

_WIDTH = {"o_orderkey": 8, "o_custkey": 8, "o_totalprice": 8, "o_orderdate": 8}


@register("table_bytes", sql=_u([
    (f"SELECT '{c}' AS column_name, CAST(count({c}) * {_WIDTH[c]} AS BIGINT) AS bytes, "
     f"count({c}) * {_WIDTH[c]} / 1048576.0 AS mb FROM orders") if c in _WIDTH else
    (f"SELECT '{c}' AS column_name, CAST(coalesce(sum(strlen({c})), 0) AS BIGINT) AS bytes, "
     f"coalesce(sum(strlen({c})), 0) / 1048576.0 AS mb FROM orders")
    for c in ORDERS_COLS]), sig_cols=["mb"])
def table_bytes(spark, sf):
    return P.table_bytes(frame(spark, sf, "orders"))


@register("unique_ratio", sql=sql("orders_nulls") + _u([
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"count(DISTINCT {c}) / count(*) AS unique_ratio FROM orders_nulls" for c in ORDERS_NULLS_COLS]),
    sig_cols=["unique_ratio"])
def unique_ratio(spark, sf):
    return P.unique_ratio(frame(spark, sf, "orders_nulls"))


_EV_TXT = ["ts_txt", "value_txt", "event_type"]
_TYPES_SQL = sql("events_text") + """, ur AS (""" + _u([
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) / count(*) AS ratio FROM events_text"
    for c in _EV_TXT]) + """),
firsts AS (""" + _u([
    f"SELECT '{c}' AS column_name, min(CASE WHEN coalesce(TRY_CAST(v AS TIMESTAMP), "
    f"try_strptime(v, '%Y/%m/%d'), try_strptime(v, '%d/%m/%Y')) IS NULL THEN 0 ELSE 1 END) AS all_parse "
    f"FROM (SELECT {c} AS v FROM events_text WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 10)"
    for c in _EV_TXT]) + """)
SELECT 'event_id' AS column_name, 'integer' AS physical_type
UNION ALL
SELECT ur.column_name, CASE WHEN all_parse = 1 THEN 'datetime_string'
  WHEN ratio < 0.05 THEN 'categorical' ELSE 'text' END
FROM ur JOIN firsts USING (column_name)"""


@register("column_types", sql=_TYPES_SQL)
def column_types(spark, sf):
    return P.column_types(frame(spark, sf, "events_text"), key="event_id")


def _any_sql(words):
    return "regexp_matches(lower(column_name), '" + "|".join(
        re.escape(w) for w in words) + "')"


def category_case_sql():
    return f"""CASE WHEN {_any_sql(P.DATETIME_WORDS)} THEN 'datetime'
  WHEN {_any_sql(P.CURRENCY_WORDS)} AND {_any_sql(P.TARGET_WORDS)} THEN 'target'
  WHEN {_any_sql(P.CURRENCY_WORDS)} THEN 'currency'
  WHEN {_any_sql(P.PERCENT_WORDS)} THEN 'percent'
  WHEN {_any_sql(P.ID_WORDS)} AND unique_ratio > {P.ID_MIN_RATIO} THEN 'identifier'
  WHEN dtype = 'bool' THEN 'boolean'
  WHEN unique_ratio < {P.CATEGORY_MAX_RATIO} OR {_any_sql(P.CATEGORY_WORDS)} THEN 'category'
  WHEN contains(dtype, 'float') OR contains(dtype, 'int') THEN
    CASE WHEN {_any_sql(P.SCORE_WORDS)} THEN 'score' ELSE 'numeric' END
  WHEN dtype = 'object' AND unique_ratio > {P.TEXT_MIN_RATIO} THEN 'text'
  ELSE 'other' END"""


def _profile_sql(src, cols, dtypes):
    return _u([f"SELECT {i} AS ordinal, '{c}' AS column_name, '{dtypes[c]}' AS dtype, "
               f"count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) / count(*) AS unique_ratio, "
               f"(count(*) - count({c})) * 100.0 / count(*) AS pct_nulls FROM {src}"
               for i, c in enumerate(cols)])


_LI_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LI_DT = {c: ("int64" if c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber") else
              "float64" if c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax") else
              "datetime64[ns]" if c == "l_shipdate" else "object") for c in _LI_COLS}


@register("column_categories", sql=f"""SELECT column_name, dtype, unique_ratio, {category_case_sql()} AS category
FROM ({_profile_sql('orders', ORDERS_COLS, ORDERS_DTYPES)}
UNION ALL {_profile_sql('lineitem', _LI_COLS, _LI_DT)}) AS p""", sig_cols=["unique_ratio"])
def column_categories(spark, sf):
    return P.column_categories(frame(spark, sf, "orders")).unionByName(
        P.column_categories(frame(spark, sf, "lineitem")))


@register("column_digest", sql=sql("orders_nulls") + f"""SELECT ordinal, column_name, dtype,
  {category_case_sql()} AS category, CAST(n_distinct AS BIGINT) AS n_distinct, pct_nulls
FROM ({_profile_sql('orders_nulls', ORDERS_NULLS_COLS, ORDERS_DTYPES)}) AS p""",
          sig_cols=["pct_nulls"])
def column_digest(spark, sf):
    return P.column_digest(frame(spark, sf, "orders_nulls"))


@register("duplicate_rows", sql=sql("dup_rows") + """SELECT CAST(sum(c) AS BIGINT) AS n_rows,
  CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM dup_rows GROUP BY ALL_COLUMNS_PLACEHOLDER)""".replace(
    "GROUP BY ALL_COLUMNS_PLACEHOLDER",
    "GROUP BY o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"))
def duplicate_rows(spark, sf):
    return P.duplicate_rows(frame(spark, sf, "dup_rows"))


def _validate_frame(spark, sf):
    e = frame(spark, sf, "events")
    return e.select("event_id", "ts", "event_type", "value",
                    F.col("user_id").cast("string").alias("user_txt"),
                    F.date_trunc("year", "ts").alias("ts_year"), "props")


_VAL_SRC = """v AS (SELECT event_id, ts, event_type, value, CAST(user_id AS VARCHAR) AS user_txt,
  date_trunc('year', ts) AS ts_year, props FROM events)"""
_VAL_COLS = ["event_id", "ts", "event_type", "value", "user_txt", "ts_year", "props"]
_VAL_STR = ["event_type", "user_txt", "props"]


@register("validate_table", sql=f"WITH {_VAL_SRC}\n" + _u(
    [f"SELECT 'warning' AS level, 'high_missing' AS rule, '{c}' AS column_name FROM v "
     f"HAVING (count(*) - count({c})) / count(*) > 0.5" for c in _VAL_COLS] +
    [f"SELECT 'info', 'constant', '{c}' FROM v HAVING count(DISTINCT {c}) = 1" for c in _VAL_COLS] +
    [f"SELECT 'info', 'numeric_text', '{c}' FROM v HAVING count(*) > 0 AND "
     f"sum(CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL THEN 1 ELSE 0 END) = 0"
     for c in _VAL_STR]))
def validate_table(spark, sf):
    return P.validate_table(_validate_frame(spark, sf))


@register("validate_nulls", sql=sql("orders_nulls") + _u(
    [f"SELECT 'warning' AS level, 'high_missing' AS rule, '{c}' AS column_name FROM orders_nulls "
     f"HAVING (count(*) - count({c})) / count(*) > 0.5" for c in ORDERS_NULLS_COLS] +
    [f"SELECT 'info', 'constant', '{c}' FROM orders_nulls HAVING count(DISTINCT {c}) = 1"
     for c in ORDERS_NULLS_COLS] +
    [f"SELECT 'info', 'numeric_text', '{c}' FROM orders_nulls HAVING count(*) > 0 AND "
     f"sum(CASE WHEN {c} IS NOT NULL AND TRY_CAST({c} AS DOUBLE) IS NULL THEN 1 ELSE 0 END) = 0"
     for c in ["o_orderstatus", "o_orderpriority"]]))
def validate_nulls(spark, sf):
    return P.validate_table(frame(spark, sf, "orders_nulls"))


@register("duplicate_rows_lineitem", sql="""SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS c FROM lineitem GROUP BY ALL)""".replace("count(*) AS c FROM", "count(*) AS c, lineitem.* FROM"))
def duplicate_rows_lineitem(spark, sf):
    return P.duplicate_rows(frame(spark, sf, "lineitem"))


@register("dtype_counts", sql="""SELECT CASE WHEN column_type IN ('BIGINT', 'INTEGER') THEN 'int64'
  WHEN column_type = 'DOUBLE' THEN 'float64' WHEN column_type LIKE 'TIMESTAMP%' OR column_type = 'DATE' THEN 'datetime64[ns]'
  ELSE 'object' END AS dtype, count(*) AS n_columns FROM (DESCRIBE SELECT * FROM lineitem) GROUP BY 1""")
def dtype_counts(spark, sf):
    return P.dtype_counts(frame(spark, sf, "lineitem"))
