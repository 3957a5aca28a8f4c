"""Registered queries: descriptive statistics."""

from __future__ import annotations

from statloom.operators import describe as D
from statloom.plans import sqlgen
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
FULL_DBL = ["mean", "std", "min", "p01", "p05", "p25", "p50", "p75", "p95", "p99", "max",
            "var", "skew", "kurt", "iqr", "cv", "range", "pct_nulls"]
ORDERS_NULLS_NUM = ["o_orderkey", "o_custkey", "o_totalprice", "mostly_null", "sparse"]


@register("describe_full", sql=sqlgen.describe_full_sql("lineitem", LINEITEM_NUM),
          sig_cols=FULL_DBL)
def describe_full(spark, sf):
    return D.describe_full(frame(spark, sf, "lineitem"), LINEITEM_NUM)


@register("describe_full_nulls",
          sql=sql("orders_nulls") + sqlgen.describe_full_sql("orders_nulls", ORDERS_NULLS_NUM),
          sig_cols=FULL_DBL)
def describe_full_nulls(spark, sf):
    return D.describe_full(frame(spark, sf, "orders_nulls"), ORDERS_NULLS_NUM)


@register("describe_numeric",
          sql=sqlgen.describe_numeric_sql("events", ["event_id", "user_id", "value"]),
          sig_cols=["mean", "std", "min", "p25", "p50", "p75", "max"])
def describe_numeric(spark, sf):
    return D.describe_numeric(frame(spark, sf, "events"))


_CAT_COLS = ["o_orderstatus", "o_orderpriority"]


@register("describe_categorical",
          sql=sql("orders_nulls") + "SELECT * FROM (" +
          sqlgen.describe_categorical_sql("orders_nulls", _CAT_COLS).replace("WITH vc", "WITH vc", 1) + ")",
          sig_cols=["mode_pct", "entropy", "pct_nulls"])
def describe_categorical(spark, sf):
    return D.describe_categorical(frame(spark, sf, "orders_nulls"), _CAT_COLS)


_CAT_BY_SQL = sql("orders_nulls") + """SELECT o_orderstatus, 'o_orderpriority' AS column_name, count(value) AS n_distinct,
  arg_min(value, (-cnt, value)) FILTER (value IS NOT NULL) AS mode, CAST(max(cnt) FILTER (value IS NOT NULL) AS BIGINT) AS mode_freq,
  max(cnt) FILTER (value IS NOT NULL) * 100.0 / sum(cnt) AS mode_pct,
  ln(CAST(sum(cnt) FILTER (value IS NOT NULL) AS DOUBLE)) - sum(cnt * ln(cnt)) FILTER (value IS NOT NULL) / sum(cnt) FILTER (value IS NOT NULL) AS entropy,
  CAST(sum(cnt) - sum(cnt) FILTER (value IS NOT NULL) AS BIGINT) AS nulls,
  (sum(cnt) - sum(cnt) FILTER (value IS NOT NULL)) * 100.0 / sum(cnt) AS pct_nulls
FROM (SELECT o_orderstatus, o_orderpriority AS value, count(*) AS cnt FROM orders_nulls GROUP BY 1, 2) GROUP BY o_orderstatus"""


@register("describe_categorical_by", sql=_CAT_BY_SQL, sig_cols=["mode_pct", "entropy", "pct_nulls"])
def describe_categorical_by(spark, sf):
    return D.describe_categorical(frame(spark, sf, "orders_nulls"), ["o_orderpriority"], by=["o_orderstatus"])


_TOP_COLS = ["l_returnflag", "l_linestatus"]


@register("categorical_top", sql=sqlgen.categorical_top_sql("lineitem", _TOP_COLS))
def categorical_top(spark, sf):
    return D.categorical_top(frame(spark, sf, "lineitem"), _TOP_COLS)
