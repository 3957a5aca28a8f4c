"""Registered queries: time series."""

from __future__ import annotations

from statloom.operators import timeseries as TS
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql

_POS = """, p AS (SELECT series, bucket, v, row_number() OVER (PARTITION BY series ORDER BY bucket) - 1 AS pos,
  count(*) OVER (PARTITION BY series) AS n FROM {src})
"""


def _pos(src):
    return _POS.format(src=src)


@register("ts_columns", sql="""SELECT 'time' AS role, 'ts' AS column_name, 0 AS ordinal
UNION ALL SELECT 'value', 'event_id', 1 FROM events HAVING count(DISTINCT event_id) > 1 AND stddev_samp(event_id) > 0
UNION ALL SELECT 'value', 'user_id', 2 FROM events HAVING count(DISTINCT user_id) > 1 AND stddev_samp(user_id) > 0
UNION ALL SELECT 'value', 'value', 3 FROM events HAVING count(DISTINCT value) > 1 AND stddev_samp(value) > 0""")
def ts_columns(spark, sf):
    return TS.ts_columns(frame(spark, sf, "events"))


@register("ts_resample_daily", sql="""SELECT series, bucket, v FROM (
SELECT 'value' AS series, date_trunc('day', ts) AS bucket, avg(value) AS v FROM events GROUP BY 2
UNION ALL SELECT 'user_id', date_trunc('day', ts), avg(user_id) FROM events GROUP BY 2)""", sig_cols=["v"])
def ts_resample_daily(spark, sf):
    return TS.resample(frame(spark, sf, "events"), "ts", ["value", "user_id"], "day")


@register("ts_resample_weekly", sql=sql("orders_weekly") + "SELECT series, bucket, v FROM orders_weekly",
          sig_cols=["v"])
def ts_resample_weekly(spark, sf):
    return TS.resample(frame(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], "week")


@register("ts_trend", sql=sql("events_daily")[:-1] + _pos("events_daily") + """SELECT series, count(*) AS n,
  regr_slope(v, pos) AS slope, regr_intercept(v, pos) AS intercept,
  CASE WHEN var_pop(v) = 0 THEN 0.0 ELSE corr(v, pos) * corr(v, pos) END AS r2,
  CASE WHEN regr_slope(v, pos) > 0 THEN 'increasing' WHEN regr_slope(v, pos) < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  CASE WHEN corr(v, pos) * corr(v, pos) > 0.7 THEN 'strong' WHEN corr(v, pos) * corr(v, pos) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength
FROM p GROUP BY series HAVING count(*) >= 10""", sig_cols=["slope", "intercept", "r2"])
def ts_trend(spark, sf):
    return TS.ts_trend(frame(spark, sf, "events_daily"))


@register("ts_trend_curves", sql=sql("events_daily")[:-1] + _pos("events_daily") + """, q AS (SELECT series, n, v, ln(v) AS lv, pos,
  pos - (n - 1) / 2.0 AS p1, (pos - (n - 1) / 2.0) * (pos - (n - 1) / 2.0) - (n * n - 1) / 12.0 AS p2 FROM p WHERE n >= 10),
g AS (SELECT series, n, avg(v) AS m, sum(p1 * v) / sum(p1 * p1) AS b1, sum(p2 * v) / sum(p2 * p2) AS b2, sum(p1 * v) AS s1, sum(p2 * v) AS s2,
  var_pop(v) * count(*) AS sst, regr_slope(lv, pos) AS ls, regr_intercept(lv, pos) AS li, regr_r2(lv, pos) AS lr, min(v) AS lo,
  regr_slope(v, pos) AS vs, regr_intercept(v, pos) AS vi, regr_r2(v, pos) AS vr FROM q GROUP BY 1, 2)
SELECT series, 'linear' AS method, n, vi AS intercept, vs AS slope, CAST(NULL AS DOUBLE) AS curvature, vr AS r2 FROM g
UNION ALL SELECT series, 'polynomial', n, m - b1 * (n - 1) / 2.0 + b2 * ((n - 1) * (n - 1) / 4.0 - (n * n - 1) / 12.0), b1 - b2 * (n - 1), b2,
  (b1 * s1 + b2 * s2) / sst FROM g
UNION ALL SELECT series, 'exponential', n, li, ls, NULL, lr FROM g WHERE lo > 0""", sig_cols=["intercept", "slope", "curvature", "r2"])
def ts_trend_curves(spark, sf):
    return TS.ts_trend_curves(frame(spark, sf, "events_daily"))


@register("ts_line_with_trend", sql=sql("events_daily")[:-1] + _pos("events_daily") + """SELECT p.series, bucket, pos, v,
  slope * pos + intercept AS fitted FROM p JOIN (SELECT series, regr_slope(v, pos) AS slope,
  regr_intercept(v, pos) AS intercept FROM p GROUP BY series) t USING (series)""", sig_cols=["v", "fitted"])
def ts_line_with_trend(spark, sf):
    return TS.ts_line_with_trend(frame(spark, sf, "events_daily"))


_DECOMP = sql("events_daily")[:-1] + _pos("events_daily") + """, d AS (SELECT *, CASE WHEN
  count(v) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 7
  THEN sum(v) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 END AS trend,
  pos % 7 AS phase FROM p WHERE n >= 24),
ph AS (SELECT series, phase, avg(v - trend) AS pm FROM d GROUP BY 1, 2),
phs AS (SELECT series, phase, pm - avg(pm) OVER (PARTITION BY series) AS seasonal FROM ph),
dec AS (SELECT d.series, bucket, pos, v, trend, seasonal, v - trend - seasonal AS resid
  FROM d JOIN phs USING (series, phase))
"""


@register("ts_decompose", sql=_DECOMP + "SELECT * FROM dec", sig_cols=["v", "trend", "seasonal", "resid"])
def ts_decompose(spark, sf):
    return TS.ts_decompose(frame(spark, sf, "events_daily"), 7)


@register("ts_strength", sql=_DECOMP + """SELECT series, stddev_samp(seasonal) AS seasonal_std,
  stddev_samp(trend) AS trend_std, stddev_samp(resid) AS resid_std,
  stddev_samp(seasonal) > 0.5 * stddev_samp(resid) AS has_seasonality,
  stddev_samp(trend) > 0.5 * stddev_samp(resid) AS has_trend, 7 AS period FROM dec GROUP BY series""",
          sig_cols=["seasonal_std", "trend_std", "resid_std"])
def ts_strength(spark, sf):
    return TS.ts_strength(frame(spark, sf, "orders_weekly").unionByName(
        frame(spark, sf, "events_daily")).filter("series != 'o_totalprice'"), 7)


_ACF = sql("orders_weekly", "events_daily")[:-1] + """, s AS (SELECT * FROM orders_weekly UNION ALL SELECT * FROM events_daily)
""" + _pos("s") + """, q AS (SELECT *, v - avg(v) OVER (PARTITION BY series) AS d FROM p WHERE n > 10),
lags AS (SELECT range AS lag FROM range(1, 41)),
a AS (SELECT q.series, lags.lag, q.n, sum(q.d * q2.d) AS num FROM q JOIN lags ON lags.lag <= least(40, floor(q.n / 4))
  JOIN q q2 ON q2.series = q.series AND q2.pos = q.pos + lags.lag GROUP BY 1, 2, 3),
acf AS (SELECT a.series, a.lag, num / den AS acf, a.n FROM a JOIN (SELECT series, sum(d * d) AS den FROM q GROUP BY 1) USING (series))
"""


@register("ts_acf", sql=_ACF + "SELECT series, CAST(lag AS INTEGER) AS lag, acf, n, abs(acf) > 2.0 / sqrt(n) AS significant FROM acf",
          sig_cols=["acf"])
def ts_acf(spark, sf):
    return TS.ts_acf(frame(spark, sf, "orders_weekly").unionByName(frame(spark, sf, "events_daily")))


@register("ts_acf_summary", sql=_ACF + """SELECT series, max(CASE WHEN lag = 1 THEN acf END) AS lag1, max(abs(acf)) AS max_abs,
  coalesce(array_to_string(list_slice(list_sort(list(lag) FILTER (WHERE abs(acf) > 2.0 / sqrt(n))), 1, 10), ','), '') AS significant_lags,
  sum(CASE WHEN abs(acf) > 2.0 / sqrt(n) THEN 1 ELSE 0 END) > 0 AS has_autocorrelation FROM acf GROUP BY series""",
          sig_cols=["lag1", "max_abs"])
def ts_acf_summary(spark, sf):
    return TS.ts_acf_summary(frame(spark, sf, "orders_weekly").unionByName(frame(spark, sf, "events_daily")))


@register("ts_status", sql=sql("events_daily", "orders_weekly") + """SELECT series, count(v) AS n,
  CASE WHEN count(v) < 10 THEN 'too few points' WHEN min(v) = max(v) THEN 'constant' ELSE 'ok' END AS status
FROM (SELECT * FROM orders_weekly UNION ALL SELECT * FROM events_daily
  UNION ALL SELECT 'one ' || series, bucket, 1.0 FROM events_daily WHERE series < 'c'
  UNION ALL SELECT 'few', bucket, v FROM events_daily WHERE bucket < TIMESTAMP '2024-01-04' AND series = 'click') GROUP BY series""")
def ts_status(spark, sf):
    daily = frame(spark, sf, "events_daily")
    one = daily.filter("series < 'c'").selectExpr("concat('one ', series) AS series", "bucket", "1.0D AS v")
    few = daily.filter("bucket < TIMESTAMP '2024-01-04' AND series = 'click'").selectExpr("'few' AS series", "bucket", "v")
    return TS.ts_status(frame(spark, sf, "orders_weekly").unionByName(daily).unionByName(one).unionByName(few))


@register("ts_resample_by", sql="""SELECT 'value|' || event_type AS series, date_trunc('day', ts) AS bucket, avg(value) AS v
FROM events GROUP BY 1, 2""", sig_cols=["v"])
def ts_resample_by(spark, sf):
    return TS.resample(frame(spark, sf, "events"), "ts", ["value"], "day", by=["event_type"])


@register("ts_strength_auto", sql=_DECOMP + """SELECT series, stddev_samp(seasonal) AS seasonal_std,
  stddev_samp(trend) AS trend_std, stddev_samp(resid) AS resid_std,
  stddev_samp(seasonal) > 0.5 * stddev_samp(resid) AS has_seasonality,
  stddev_samp(trend) > 0.5 * stddev_samp(resid) AS has_trend,
  CASE WHEN (SELECT count(*) FROM events) > 365 THEN 7 ELSE 4 END AS period FROM dec GROUP BY series""",
          sig_cols=["seasonal_std", "trend_std", "resid_std"])
def ts_strength_auto(spark, sf):
    """The period follows from the number of events with a time."""
    return TS.ts_strength_auto(frame(spark, sf, "events_daily"), frame(spark, sf, "events").filter("ts IS NOT NULL").count())


@register("ts_range", sql="""SELECT 'ts' AS date_column, min(ts) AS start, max(ts) AS "end",
  datesub('day', min(ts), max(ts)) AS days FROM events""")
def ts_range(spark, sf):
    return TS.ts_range(frame(spark, sf, "events"), "ts")


@register("ts_adf")
def ts_adf(spark, sf):
    return TS.ts_adf(frame(spark, sf, "orders_weekly").unionByName(frame(spark, sf, "events_daily")))
