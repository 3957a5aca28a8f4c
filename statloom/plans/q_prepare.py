"""Registered queries: cleaning and feature derivation."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import prepare as C
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql


@register("sample_n", sql="""SELECT * FROM orders
ORDER BY md5('42' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 10000""", sig_cols=["o_totalprice"])
def sample_n(spark, sf):
    return C.sample_n(frame(spark, sf, "orders"), "o_orderkey")


@register("impute_median", sql=sql("orders_nulls") + """SELECT o_orderkey,
  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_nulls)) AS o_totalprice,
  mostly_null, sparse FROM orders_nulls""", sig_cols=["o_totalprice", "mostly_null", "sparse"])
def impute_median(spark, sf):
    d = frame(spark, sf, "orders_nulls").select("o_orderkey", "o_totalprice", "mostly_null", "sparse")
    return C.impute_median(d, ["o_totalprice", "mostly_null", "sparse"])


@register("impute_mode", sql=sql("orders_nulls") + """SELECT o_orderkey,
  coalesce(o_orderpriority, (SELECT arg_min(o_orderpriority, (-c, o_orderpriority)) FROM
    (SELECT o_orderpriority, count(*) AS c FROM orders_nulls WHERE o_orderpriority IS NOT NULL GROUP BY 1)))
  AS o_orderpriority, o_orderstatus FROM orders_nulls""")
def impute_mode(spark, sf):
    d = frame(spark, sf, "orders_nulls").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return C.impute_mode(d, ["o_orderpriority", "o_orderstatus"])


@register("fill_ffill_bfill", sql=sql("orders_nulls") + """SELECT o_orderkey, coalesce(
  last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  AS o_orderdate FROM orders_nulls""")
def fill_ffill_bfill(spark, sf):
    d = frame(spark, sf, "orders_nulls").select("o_orderkey", "o_orderdate")
    return C.fill_ffill_bfill(d, "o_orderdate", ["o_orderkey"])


@register("drop_sparse_columns", sql=sql("orders_nulls") + "SELECT * EXCLUDE (sparse) FROM orders_nulls",
          sig_cols=["o_totalprice", "mostly_null"])
def drop_sparse_columns(spark, sf):
    return C.drop_sparse_columns(frame(spark, sf, "orders_nulls"))


@register("parse_datetime", sql=sql("events_text") + """SELECT event_id,
  coalesce(TRY_CAST(ts_txt AS TIMESTAMP), try_strptime(ts_txt, '%Y/%m/%d'), try_strptime(ts_txt, '%d/%m/%Y'))
  AS ts_txt FROM events_text""")
def parse_datetime(spark, sf):
    return C.parse_datetime(frame(spark, sf, "events_text").select("event_id", "ts_txt"), ["ts_txt"])


@register("datetime_features", sql="""SELECT o_orderkey, o_orderdate,
  CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
  CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday,
  CAST(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS o_orderdate_is_weekend,
  datesub('day', (SELECT min(o_orderdate) FROM orders), o_orderdate) AS o_orderdate_days_since
FROM orders""")
def datetime_features(spark, sf):
    return C.datetime_features(frame(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@register("coerce_numeric", sql=sql("events_text") + """SELECT event_id, TRY_CAST(value_txt AS DOUBLE) AS value_txt
FROM events_text""", sig_cols=["value_txt"])
def coerce_numeric(spark, sf):
    return C.coerce_numeric(frame(spark, sf, "events_text").select("event_id", "value_txt"), ["value_txt"])


@register("skew_transform", sql="""SELECT event_id, user_id, value, ln(1 + value) AS value_log FROM events""",
          sig_cols=["value", "value_log"])
def skew_transform(spark, sf):
    return C.skew_transform(frame(spark, sf, "events").select("event_id", "user_id", "value"),
                            ["user_id", "value"])


@register("skew_transform_docs", sql="""SELECT doc_id, n_chars, ln(1 + n_chars) AS n_chars_log FROM documents""",
          sig_cols=["n_chars_log"])
def skew_transform_docs(spark, sf):
    return C.skew_transform(frame(spark, sf, "documents").select("doc_id", "n_chars"), ["n_chars"])


@register("label_encode_binary", sql="""SELECT l_orderkey, l_linenumber, l_linestatus,
  CAST(CASE l_linestatus WHEN (SELECT min(l_linestatus) FROM lineitem) THEN 0 ELSE 1 END AS BIGINT)
  AS l_linestatus_encoded FROM lineitem""")
def label_encode_binary(spark, sf):
    d = frame(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return C.label_encode_binary(d, "l_linestatus")


_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("one_hot", sql=sql("orders_nulls") + "SELECT o_orderkey, o_orderpriority, " + ", ".join(
    f"coalesce(o_orderpriority = '{p}', false) AS \"o_orderpriority_{p}\"" for p in _PRIO[1:]) +
    " FROM orders_nulls")
def one_hot(spark, sf):
    return C.one_hot(frame(spark, sf, "orders_nulls").select("o_orderkey", "o_orderpriority"),
                     "o_orderpriority")


@register("freq_encode", sql="""SELECT o_orderkey, o_custkey, c * 1.0 / (SELECT count(*) FROM orders) AS o_custkey_freq
FROM orders JOIN (SELECT o_custkey, count(*) AS c FROM orders GROUP BY 1) USING (o_custkey)""",
          sig_cols=["o_custkey_freq"])
def freq_encode(spark, sf):
    return C.freq_encode(frame(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")


@register("text_features", sql="""SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS text_n_chars,
  CAST(CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) = '' THEN 0 ELSE
    len(string_split(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' ')) END AS INTEGER) AS text_n_words
FROM documents""")
def text_features(spark, sf):
    return C.text_features(frame(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@register("complete_cases", sql=sql("orders_nulls") + """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders_nulls
WHERE o_totalprice IS NOT NULL AND o_orderdate IS NOT NULL""", sig_cols=["o_totalprice"])
def complete_cases(spark, sf):
    d = frame(spark, sf, "orders_nulls").select("o_orderkey", "o_totalprice", "o_orderdate")
    return C.complete_cases(d, ["o_totalprice", "o_orderdate"])


@register("standardize", sql=sql("order_rollup") + """SELECT o_key,
  (n_lines - avg(n_lines) OVER ()) / stddev_pop(n_lines) OVER () AS n_lines,
  (sum_qty - avg(sum_qty) OVER ()) / stddev_pop(sum_qty) OVER () AS sum_qty,
  (avg_disc - avg(avg_disc) OVER ()) / stddev_pop(avg_disc) OVER () AS avg_disc FROM order_rollup""",
          sig_cols=["n_lines", "sum_qty", "avg_disc"])
def standardize(spark, sf):
    return C.standardize(frame(spark, sf, "order_rollup"), ["n_lines", "sum_qty", "avg_disc"], keep=["o_key"])


@register("humanize_number", sql="""SELECT o_orderkey, CASE WHEN abs(o_totalprice) >= 1e6 THEN printf('%.2fM', o_totalprice / 1e6)
  WHEN abs(o_totalprice) >= 1e3 THEN printf('%.2fK', o_totalprice / 1e3) ELSE printf('%.2f', o_totalprice) END AS label
FROM orders""")
def humanize_number(spark, sf):
    o = frame(spark, sf, "orders")
    return o.select("o_orderkey", C.humanize_number(F.col("o_totalprice")).alias("label"))


_MAPPING = {"o_orderkey": "identifier", "o_custkey": "numeric", "o_orderstatus": "category",
            "o_totalprice": "currency", "o_orderdate": "datetime", "o_orderpriority": "category",
            "mostly_null": "numeric", "sparse": "numeric"}


_PIPE_SQL = sql("orders_nulls") + """, f AS (SELECT o_orderkey, o_custkey, o_orderstatus,
  coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM orders_nulls)) AS o_totalprice,
  coalesce(last_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(o_orderdate IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS o_orderdate,
  coalesce(o_orderpriority, (SELECT arg_min(o_orderpriority, (-c, o_orderpriority)) FROM
    (SELECT o_orderpriority, count(*) AS c FROM orders_nulls WHERE o_orderpriority IS NOT NULL GROUP BY 1))) AS o_orderpriority,
  mostly_null FROM orders_nulls)
SELECT *, coalesce(o_orderstatus = 'O', false) AS o_orderstatus_O, coalesce(o_orderstatus = 'P', false) AS o_orderstatus_P,
  CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
  CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day,
  CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday,
  CAST(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS o_orderdate_is_weekend,
  datesub('day', (SELECT min(o_orderdate) FROM f), o_orderdate) AS o_orderdate_days_since,
""" + ", ".join(f"coalesce(o_orderpriority = '{p}', false) AS \"o_orderpriority_{p}\"" for p in _PRIO[1:]) + """
FROM f"""


@register("preprocess_pipeline", sql=_PIPE_SQL, sig_cols=["o_totalprice", "mostly_null"])
def preprocess_pipeline(spark, sf):
    return C.preprocess(frame(spark, sf, "orders_nulls"), _MAPPING, key="o_orderkey")
