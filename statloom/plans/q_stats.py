"""Registered queries: correlation, outliers and chart frames."""

from __future__ import annotations

from itertools import combinations

from statloom.operators import charts as G
from statloom.operators import correlate as R
from statloom.operators import outliers as O
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql

ROLL = ["o_key", "n_lines", "sum_qty", "sum_price", "avg_disc"]
ROLL_KEPT = ["n_lines", "sum_qty", "avg_disc"]
PART = ["seq_no", "p_size", "p_retailprice"]


def _u(parts):
    return "\nUNION ALL\n".join(parts)


def _pearson_sql(src, cols):
    return _u([f"SELECT '{a}' AS var1, '{b}' AS var2, count({a} + {b}) AS n, corr({b}, {a}) AS r FROM {src}"
               for a, b in combinations(cols, 2)])


@register("corr_columns", sql=sql("order_rollup") + """SELECT ordinal, column_name, reason = 'kept' AS kept, reason FROM (
SELECT 0 AS ordinal, 'o_key' AS column_name, 'id_like' AS reason
UNION ALL SELECT 1, 'n_lines', CASE WHEN count(DISTINCT n_lines) > count(*) * 0.95 THEN 'near_unique' ELSE 'kept' END FROM order_rollup
UNION ALL SELECT 2, 'sum_qty', CASE WHEN count(DISTINCT sum_qty) > count(*) * 0.95 THEN 'near_unique' ELSE 'kept' END FROM order_rollup
UNION ALL SELECT 3, 'sum_price', CASE WHEN count(DISTINCT sum_price) > count(*) * 0.95 THEN 'near_unique' ELSE 'kept' END FROM order_rollup
UNION ALL SELECT 4, 'avg_disc', CASE WHEN count(DISTINCT avg_disc) > count(*) * 0.95 THEN 'near_unique' ELSE 'kept' END FROM order_rollup)""")
def corr_columns(spark, sf):
    return R.corr_columns(frame(spark, sf, "order_rollup"))


@register("corr_pearson", sql=sql("order_rollup") + _pearson_sql("order_rollup", ROLL[1:]), sig_cols=["r"])
def corr_pearson(spark, sf):
    return R.corr_pearson(frame(spark, sf, "order_rollup"), ROLL[1:])


@register("corr_pearson_nulls", sql=sql("orders_nulls") + _pearson_sql(
    "orders_nulls", ["o_custkey", "o_totalprice", "mostly_null", "sparse"]), sig_cols=["r"])
def corr_pearson_nulls(spark, sf):
    return R.corr_pearson(frame(spark, sf, "orders_nulls"),
                          ["o_custkey", "o_totalprice", "mostly_null", "sparse"])


def _avg_rank_sql(c):
    return (f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + "
            f"(count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END")


@register("corr_spearman", sql=sql("part_numeric") + "SELECT * FROM (WITH rk AS (SELECT " + ", ".join(
    f"{_avg_rank_sql(c)} AS {c}" for c in PART) + " FROM part_numeric)\n" + _pearson_sql("rk", PART) + ")",
    sig_cols=["r"])
def corr_spearman(spark, sf):
    return R.corr_spearman(frame(spark, sf, "part_numeric"), PART)


_SIG_SQL = sql("order_rollup") + f"""SELECT var1, var2, n, r, t_stat,
  CASE WHEN abs(r) > 0.8 THEN 'very_strong' WHEN abs(r) > 0.6 THEN 'strong' ELSE 'moderate' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction,
  CAST(row_number() OVER (ORDER BY abs(r) DESC, var1, var2) AS INTEGER) AS rank
FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t_stat FROM ({_pearson_sql('order_rollup', ROLL_KEPT)}))
WHERE abs(r) > 0.3 AND abs(r) < 0.99 AND n > 3 AND abs(t_stat) > 1.96
QUALIFY rank <= 20"""


@register("corr_significant", sql=_SIG_SQL, sig_cols=["r", "t_stat"])
def corr_significant(spark, sf):
    return R.corr_significant(frame(spark, sf, "order_rollup"), ROLL, with_p=False)


_TGT_SQL = sql("order_rollup") + f"""SELECT target, feature, r, abs(r) AS abs_r,
  CAST(row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC, feature) AS INTEGER) AS rank
FROM (SELECT var1 AS target, var2 AS feature, r FROM p UNION ALL SELECT var2, var1, r FROM p)
WHERE target IN ('sum_price') AND abs(r) > 0.2
QUALIFY rank <= 10"""
_TGT_SQL = _TGT_SQL.replace("SELECT target, feature", "SELECT * FROM (WITH p AS (" + _pearson_sql(
    "order_rollup", ROLL[1:]) + ")\nSELECT target, feature", 1) + ")"


@register("corr_target", sql=_TGT_SQL, sig_cols=["r", "abs_r"])
def corr_target(spark, sf):
    return R.corr_target(frame(spark, sf, "order_rollup"), ROLL, max_unique_ratio=None)


@register("heatmap_cells", sql=sql("order_rollup") + f"""SELECT var1, var2, round(r, 2) AS r FROM (
SELECT var1, var2, r FROM ({_pearson_sql('order_rollup', ROLL[1:])})
UNION ALL SELECT var2, var1, r FROM ({_pearson_sql('order_rollup', ROLL[1:])})
UNION ALL {_u([f"SELECT '{c}', '{c}', 1.0" for c in ROLL[1:]])})""")
def heatmap_cells(spark, sf):
    return R.heatmap_cells(frame(spark, sf, "order_rollup"), ROLL[1:])


_EV = ["user_id", "value"]


def _first_keys_sql(src, c, cond):
    return (f"(SELECT coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id), '') FROM "
            f"(SELECT event_id FROM {src} WHERE {cond} ORDER BY event_id LIMIT 10))")


def _iqr_sql(c):
    q = f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM events)"
    lo, hi = "(q1 - 1.5 * (q3 - q1))", "(q3 + 1.5 * (q3 - q1))"
    cond = f"{c} < {lo} OR {c} > {hi}"
    return (f"SELECT '{c}' AS column_name, q1, q3, {lo} AS lower, {hi} AS upper, "
            f"(SELECT count(*) FROM events, {q} WHERE {cond}) AS count, "
            f"(SELECT count(*) FROM events, {q} WHERE {cond}) * 100.0 / (SELECT count(*) FROM events) AS pct, "
            f"(SELECT coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id), '') FROM "
            f"(SELECT event_id FROM events, {q} WHERE {cond} ORDER BY event_id LIMIT 10)) AS first_keys "
            f"FROM {q}")


@register("outliers_iqr", sql=_u([_iqr_sql(c) for c in _EV]),
          sig_cols=["q1", "q3", "lower", "upper", "pct"])
def outliers_iqr(spark, sf):
    return O.outliers_iqr(frame(spark, sf, "events"), "event_id", _EV)


def _z_sql(c):
    st = f"(SELECT avg({c}) AS m, stddev_pop({c}) AS s, count({c}) AS n FROM events)"
    cond = f"abs({c} - m) / s > 3"
    return (f"SELECT '{c}' AS column_name, m AS mean, s AS std, "
            f"(SELECT count(*) FROM events, {st} WHERE {cond}) AS count, "
            f"(SELECT count(*) FROM events, {st} WHERE {cond}) * 100.0 / n AS pct, "
            f"(SELECT coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id), '') FROM "
            f"(SELECT event_id FROM events, {st} WHERE {cond} ORDER BY event_id LIMIT 10)) AS first_keys "
            f"FROM {st}")


@register("outliers_zscore", sql=_u([_z_sql(c) for c in _EV]), sig_cols=["mean", "std", "pct"])
def outliers_zscore(spark, sf):
    return O.outliers_zscore(frame(spark, sf, "events"), "event_id", _EV)


def _hist_sql(c):
    w = "((hi - lo) / 30)"
    return (f"SELECT '{c}' AS column_name, bin, lo + bin * {w} AS lower, lo + (bin + 1) * {w} AS upper, "
            f"count(*) AS count FROM (SELECT CAST(CASE WHEN hi > lo THEN least(floor(({c} - lo) / {w}), 29) "
            f"ELSE 0 END AS INTEGER) AS bin, lo, hi FROM events, (SELECT min({c}) AS lo, max({c}) AS hi FROM events)) "
            f"GROUP BY bin, lo, hi")


@register("histogram_bins", sql=_u([_hist_sql(c) for c in _EV]), sig_cols=["lower", "upper"])
def histogram_bins(spark, sf):
    return G.histogram_bins(frame(spark, sf, "events"), _EV)


@register("chart_bar", sql="""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS y_sum, count(*) AS n
FROM lineitem GROUP BY 1, 2""", sig_cols=["y_sum"])
def chart_bar(spark, sf):
    return G.chart_bar(frame(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus")


@register("chart_box", sql="""SELECT l_returnflag, q1, median, q3,
  min(CASE WHEN inside THEN l_extendedprice END) AS whisker_low,
  max(CASE WHEN inside THEN l_extendedprice END) AS whisker_high,
  sum(CASE WHEN inside THEN 0 ELSE 1 END) AS n_outliers, count(*) AS n
FROM (SELECT l.l_returnflag, l_extendedprice, q1, median, q3,
   l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l_extendedprice <= q3 + 1.5 * (q3 - q1) AS inside
 FROM lineitem l JOIN (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1,
   quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3
   FROM lineitem GROUP BY l_returnflag) q USING (l_returnflag))
GROUP BY l_returnflag, q1, median, q3""", sig_cols=["q1", "median", "q3", "whisker_low", "whisker_high"])
def chart_box(spark, sf):
    return G.chart_box(frame(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag")


@register("chart_violin", sql="""SELECT event_type, bin, lo + (bin + 0.5) * ((hi - lo) / 50) AS center, count(*) AS count,
  CASE WHEN hi > lo THEN count(*) / (n * ((hi - lo) / 50)) END AS density
FROM (SELECT e.event_type, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INTEGER) AS bin,
  lo, hi, n FROM events e JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi, count(*) AS n
  FROM events GROUP BY event_type) g USING (event_type))
GROUP BY event_type, bin, lo, hi, n""", sig_cols=["center", "density"])
def chart_violin(spark, sf):
    return G.chart_violin(frame(spark, sf, "events"), "value", "event_type")


@register("chart_pie", sql="""SELECT o_orderpriority, total, total / sum(total) OVER () AS share FROM (
SELECT o_orderpriority, CAST(sum(o_totalprice) AS DOUBLE) AS total FROM orders GROUP BY 1)""",
          sig_cols=["total", "share"])
def chart_pie(spark, sf):
    return G.chart_pie(frame(spark, sf, "orders"), "o_orderpriority", "o_totalprice")


def _kendall_sql(src, cols):
    parts = []
    for a, b in combinations(cols, 2):
        parts.append(f"""SELECT '{a}' AS var1, '{b}' AS var2, n, s / sqrt((n0 - n1) * (n0 - n2)) AS tau FROM (
  SELECT (SELECT count(*) FROM p) AS n, (SELECT count(*) * (count(*) - 1) / 2 FROM p) AS n0,
    (SELECT coalesce(sum(t * (t - 1) / 2), 0) FROM (SELECT count(*) AS t FROM p GROUP BY {a})) AS n1,
    (SELECT coalesce(sum(t * (t - 1) / 2), 0) FROM (SELECT count(*) AS t FROM p GROUP BY {b})) AS n2,
    (SELECT sum(sign(p1.{a} - p2.{a}) * sign(p1.{b} - p2.{b})) FROM p p1 JOIN p p2 ON p1.i < p2.i) AS s)""")
    sel = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * FROM (WITH p AS (SELECT row_number() OVER () AS i, {sel} FROM {src}) " + "\nUNION ALL\n".join(parts) + ")"


@register("corr_kendall", sql=sql("part_numeric") + _kendall_sql("part_numeric", PART), sig_cols=["tau"])
def corr_kendall(spark, sf):
    from statloom.operators.kendall import corr_kendall as kt
    return kt(frame(spark, sf, "part_numeric"), PART)


@register("corr_kendall_customer", sql=_kendall_sql("customer", ["c_nationkey", "c_acctbal"]), sig_cols=["tau"])
def corr_kendall_customer(spark, sf):
    from statloom.operators.kendall import corr_kendall as kt
    return kt(frame(spark, sf, "customer"), ["c_nationkey", "c_acctbal"])


@register("outliers_isolation_forest")
def outliers_isolation_forest(spark, sf):
    from statloom.operators.iforest import outliers_isolation_forest as iso
    return iso(frame(spark, sf, "events"), "event_id", ["user_id", "value"])["summary"]


@register("isolation_scores")
def isolation_scores(spark, sf):
    from statloom.operators.iforest import outliers_isolation_forest as iso
    return iso(frame(spark, sf, "events"), "event_id", ["user_id", "value"])["scores"]


@register("chart_line", sql="""SELECT CAST(o_orderdate AS DATE) AS d, o_orderstatus, avg(o_totalprice) AS y_mean, count(*) AS n
FROM orders GROUP BY ALL""", sig_cols=["y_mean"])
def chart_line(spark, sf):
    o = frame(spark, sf, "orders").selectExpr("CAST(o_orderdate AS DATE) AS d", "o_orderstatus", "o_totalprice")
    return G.chart_line(o, "d", "o_totalprice", "o_orderstatus")


@register("chart_scatter", sql="""SELECT l_quantity, l_discount, l_returnflag, count(*) AS n FROM lineitem
WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL GROUP BY ALL""")
def chart_scatter(spark, sf):
    return G.chart_scatter(frame(spark, sf, "lineitem"), "l_quantity", "l_discount", "l_returnflag")


_SEG = """(SELECT event_type, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count(*) AS n FROM events GROUP BY 1)"""


def _iqr_by_sql(c):
    return (f"SELECT '{c}' AS column_name, q.event_type, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper, "
            f"coalesce(o.k, 0) AS count, coalesce(o.k, 0) * 100.0 / n AS pct FROM {_SEG.format(c=c)} q LEFT JOIN ("
            f"SELECT e.event_type, count(*) AS k FROM events e JOIN {_SEG.format(c=c)} s ON e.event_type = s.event_type "
            f"WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1) GROUP BY 1) o ON q.event_type = o.event_type")


@register("outliers_iqr_by", sql=_u([_iqr_by_sql(c) for c in _EV]), sig_cols=["q1", "q3", "lower", "upper", "pct"])
def outliers_iqr_by(spark, sf):
    return O.outliers_iqr(frame(spark, sf, "events"), "event_id", _EV, by=["event_type"]).drop("first_keys")


@register("describe_by", sql=_u([
    f"SELECT '{c}' AS column_name, event_type, count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM events GROUP BY 2" for c in _EV]),
    sig_cols=["mean", "std", "min", "p25", "p50", "p75", "max"])
def describe_by(spark, sf):
    from statloom.operators.describe import describe_numeric
    return describe_numeric(frame(spark, sf, "events"), _EV, by=["event_type"])
