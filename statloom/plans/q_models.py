"""Registered queries: mixtures, hierarchy, factor analysis, distance correlation, encoding, imputation, fitting, forecasts."""

from __future__ import annotations

from statloom.operators import correlate, distance, encode, factor, fitting, forecast, hierarchy, mixture, neighbours, sketch, tukey
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql

_PART = ["seq_no", "p_size", "p_retailprice"]
_VEC8 = [f"x{i}" for i in range(8)]


# --- Gaussian mixture ---

@register("gmm_sweep")
def gmm_sweep(spark, sf):
    return mixture.gmm_sweep(frame(spark, sf, "part_numeric"), _PART, range(1, 5))


@register("gmm_components")
def gmm_components(spark, sf):
    return mixture.gmm_components(frame(spark, sf, "vec_8d"), 3, _VEC8)


@register("gmm_labels")
def gmm_labels(spark, sf):
    return mixture.gmm_labels(frame(spark, sf, "vec_8d"), "vec_id", 3, _VEC8).select("vec_id", "component", "responsibility")


# --- incremental PCA ---

@register("incremental_pca")
def incremental_pca(spark, sf):
    """Frequent directions over all 64 components of the vectors."""
    from pyspark.sql import functions as F
    v = frame(spark, sf, "embeddings").select(*[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(64)])
    return sketch.incremental_pca(v)


# --- hierarchical clustering ---

# Prim's algorithm: every step takes the nearest point that is left and brings the others' distances up to date
_HEIGHTS = """WITH RECURSIVE p AS (SELECT row_number() OVER (ORDER BY x, y) AS i, x, y, n FROM (
  SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, count(*) AS n FROM part GROUP BY 1, 2)),
t AS (SELECT i, x, y, CAST(1e300 AS DOUBLE) AS best, 0 AS step FROM p
  UNION ALL
  SELECT i, x, y, least(best, sqrt((x - mx) * (x - mx) + (y - my) * (y - my))), step + 1
  FROM (SELECT *, first_value(i) OVER w AS m, first_value(x) OVER w AS mx, first_value(y) OVER w AS my FROM t WINDOW w AS (ORDER BY best, i))
  WHERE i <> m),
h AS (SELECT min(best) AS height FROM t WHERE step > 0 GROUP BY step)
SELECT round(height, 6) AS height, CAST(count(*) AS BIGINT) AS merges FROM h GROUP BY 1
UNION ALL SELECT 0.0, CAST(sum(n - 1) AS BIGINT) FROM p HAVING sum(n - 1) > 0"""


@register("hierarchy_heights", sql=_HEIGHTS)
def hierarchy_heights(spark, sf):
    """Merge heights of single linkage in the columns' own units."""
    from pyspark.sql import functions as F
    h = hierarchy.merge_heights(frame(spark, sf, "part"), ["p_size", "p_retailprice"], scale=False)
    return h.groupBy(F.round("height", 6).alias("height")).agg(F.sum("merges").alias("merges"))


@register("hierarchy_merges")
def hierarchy_merges(spark, sf):
    return hierarchy.hierarchy(frame(spark, sf, "customer"), ["c_nationkey", "c_acctbal"])["merges"]


# --- correspondence ---

@register("mca_inertia")
def mca_inertia(spark, sf):
    return factor.mca(frame(spark, sf, "part"), ["p_brand", "p_type"])["mca_inertia"]


@register("mca_levels")
def mca_levels(spark, sf):
    return factor.mca(frame(spark, sf, "part"), ["p_brand", "p_type"])["mca_levels"]


_CA_TOTAL = """WITH c AS (SELECT o_orderpriority AS r, o_orderstatus AS k, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2),
t AS (SELECT *, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY r) AS cr, sum(c) OVER (PARTITION BY k) AS ck FROM c)
SELECT sum(c * c / (cr * ck)) - 1 AS total_inertia FROM t"""


@register("ca_total_inertia", sql=_CA_TOTAL, sig_cols=["total_inertia"])
def ca_total_inertia(spark, sf):
    """All axes of the two-way table together: the chi-square over the rows."""
    from pyspark.sql import functions as F
    got = factor.ca(frame(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")["ca_inertia"]
    return got.agg(F.sum("eigenvalue").alias("total_inertia"))


# the table has three columns, so two axes: their sum and sum of squares give both
_CA = """WITH c AS (SELECT o_orderpriority AS r, o_orderstatus AS k, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2),
rs AS (SELECT r, sum(c) AS cr FROM c GROUP BY 1), ks AS (SELECT k, sum(c) AS ck FROM c GROUP BY 1), n AS (SELECT sum(c) AS n FROM c),
s AS (SELECT rs.r, ks.k, (coalesce(c, 0) / n - cr / n * ck / n) / sqrt(cr / n * ck / n) AS s FROM rs CROSS JOIN ks CROSS JOIN n
  LEFT JOIN c ON c.r = rs.r AND c.k = ks.k),
g AS (SELECT a.k, b.k AS l, sum(a.s * b.s) AS v FROM s a JOIN s b USING (r) GROUP BY 1, 2),
m AS (SELECT sum(v) FILTER (k = l) AS t, sum(v * v) AS q FROM g),
e AS (SELECT 1 AS component, (t + sqrt(2 * q - t * t)) / 2 AS eigenvalue, t FROM m
  UNION ALL SELECT 2, (t - sqrt(2 * q - t * t)) / 2, t FROM m)
SELECT CAST(component AS INTEGER) AS component, round(eigenvalue, 12) AS eigenvalue, round(eigenvalue / t, 6) AS inertia,
  round(sum(eigenvalue) OVER (ORDER BY component) / t, 6) AS cumulative FROM e"""


@register("ca_inertia", sql=_CA)
def ca_inertia(spark, sf):
    from pyspark.sql import functions as F
    got = factor.ca(frame(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")["ca_inertia"]
    return got.select("component", F.round("eigenvalue", 12).alias("eigenvalue"), F.round("inertia", 6).alias("inertia"),
                      F.round("cumulative", 6).alias("cumulative"))


@register("ca_points")
def ca_points(spark, sf):
    return factor.ca(frame(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")["ca_points"]


# --- distance correlation ---

_DCOR = sql("part_numeric") + """, p AS (SELECT row_number() OVER (ORDER BY seq_no) AS i, CAST(seq_no AS DOUBLE) AS a,
  CAST(p_size AS DOUBLE) AS b, p_retailprice AS c FROM part_numeric),
d AS (SELECT l.i, abs(l.a - r.a) AS a, abs(l.b - r.b) AS b, abs(l.c - r.c) AS c FROM p l, p r),
m AS (SELECT i, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM d GROUP BY i),
g AS (SELECT avg(a * b) AS ab, avg(a * c) AS ac, avg(b * c) AS bc, avg(a * a) AS aa, avg(b * b) AS bb, avg(c * c) AS cc FROM d),
h AS (SELECT count(*) AS n, avg(a * b) AS ab, avg(a * c) AS ac, avg(b * c) AS bc, avg(a * a) AS aa, avg(b * b) AS bb, avg(c * c) AS cc,
  avg(a) AS a, avg(b) AS b, avg(c) AS c FROM m),
v AS (SELECT n, g.ab + h.a * h.b - 2 * h.ab AS ab, g.ac + h.a * h.c - 2 * h.ac AS ac, g.bc + h.b * h.c - 2 * h.bc AS bc,
  g.aa + h.a * h.a - 2 * h.aa AS aa, g.bb + h.b * h.b - 2 * h.bb AS bb, g.cc + h.c * h.c - 2 * h.cc AS cc FROM g, h)
SELECT 'seq_no' AS var1, 'p_size' AS var2, n, sqrt(ab) AS dcov, sqrt(ab / sqrt(aa * bb)) AS dcor FROM v
UNION ALL SELECT 'seq_no', 'p_retailprice', n, sqrt(ac), sqrt(ac / sqrt(aa * cc)) FROM v
UNION ALL SELECT 'p_size', 'p_retailprice', n, sqrt(bc), sqrt(bc / sqrt(bb * cc)) FROM v"""


@register("corr_distance", sql=_DCOR, sig_cols=["dcov", "dcor"])
def corr_distance(spark, sf):
    return distance.corr_distance(frame(spark, sf, "part_numeric"), _PART)


_PARTIAL = sql("order_rollup") + """, r AS (SELECT count(*) AS n, corr(n_lines, sum_qty) AS a, corr(n_lines, avg_disc) AS b,
  corr(sum_qty, avg_disc) AS c FROM order_rollup)
SELECT 'n_lines' AS var1, 'sum_qty' AS var2, n, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS r_partial FROM r
UNION ALL SELECT 'n_lines', 'avg_disc', n, (b - a * c) / sqrt((1 - a * a) * (1 - c * c)) FROM r
UNION ALL SELECT 'sum_qty', 'avg_disc', n, (c - a * b) / sqrt((1 - a * a) * (1 - b * b)) FROM r"""


@register("corr_partial", sql=_PARTIAL, sig_cols=["r_partial"])
def corr_partial(spark, sf):
    return correlate.corr_partial(frame(spark, sf, "order_rollup"), ["n_lines", "sum_qty", "avg_disc"])


# --- target encoding ---


def _target_sql() -> str:
    """Out-of-fold means; folds are the last digit of the key, as crc32 has no SQL twin."""
    return """WITH f AS (SELECT o_orderkey, o_orderpriority AS a, o_custkey AS b, CAST(o_totalprice AS DOUBLE) AS y,
  o_orderkey % 5 AS fold FROM orders_nulls),
m AS (SELECT fold, (sum(sum(y)) OVER () - sum(y)) / (sum(count(y)) OVER () - count(y)) AS mean FROM f GROUP BY fold),
ga AS (SELECT a, fold, sum(coalesce(sum(y), 0)) OVER (PARTITION BY a) - coalesce(sum(y), 0) AS s,
  sum(count(y)) OVER (PARTITION BY a) - count(y) AS n FROM f GROUP BY a, fold),
gb AS (SELECT b, fold, sum(coalesce(sum(y), 0)) OVER (PARTITION BY b) - coalesce(sum(y), 0) AS s,
  sum(count(y)) OVER (PARTITION BY b) - count(y) AS n FROM f GROUP BY b, fold)
SELECT f.o_orderkey, (ga.s + 10 * m.mean) / (ga.n + 10) AS o_orderpriority_target,
  (gb.s + 10 * m.mean) / (gb.n + 10) AS o_custkey_target
FROM f JOIN m USING (fold) JOIN ga ON f.a IS NOT DISTINCT FROM ga.a AND f.fold = ga.fold
JOIN gb ON f.b IS NOT DISTINCT FROM gb.b AND f.fold = gb.fold"""


@register("target_encode", sql=sql("orders_nulls") + "SELECT * FROM (" + _target_sql() + ")",
          sig_cols=["o_orderpriority_target", "o_custkey_target"])
def target_encode(spark, sf):
    from pyspark.sql import functions as F
    o = frame(spark, sf, "orders_nulls").select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice")
    out = encode.target_encode(o, ["o_orderpriority", "o_custkey"], "o_totalprice", fold=(F.col("o_orderkey") % 5).cast("int"))
    return out.select("o_orderkey", "o_orderpriority_target", "o_custkey_target")


# --- KNN imputation ---

_KNN_COLS = ["c_acctbal", "c_nationkey", "seg"]

def _knn_sql() -> str:
    cols = _KNN_COLS
    total = " + ".join(f"CASE WHEN l.{c} IS NULL OR r.{c} IS NULL THEN 0 ELSE (l.{c} - r.{c}) * (l.{c} - r.{c}) END" for c in cols)
    common = " + ".join(f"CASE WHEN l.{c} IS NULL OR r.{c} IS NULL THEN 0 ELSE 1 END" for c in cols)
    parts = []
    for c in cols:
        parts.append(f"""(SELECT c_custkey AS id, avg(v) AS v FROM (SELECT l.c_custkey, r.{c} AS v,
    row_number() OVER (PARTITION BY l.c_custkey ORDER BY ({total}) * {len(cols)}.0 / ({common}), r.c_custkey) AS nth
    FROM customer_gaps l JOIN customer_gaps r ON l.{c} IS NULL AND r.{c} IS NOT NULL AND ({common}) > 0) WHERE nth <= 5 GROUP BY 1)""")
    pick = ", ".join(f"coalesce(t.{c}, i{j}.v, (SELECT avg({c}) FROM customer_gaps)) AS {c}" for j, c in enumerate(cols))
    joins = " ".join(f"LEFT JOIN {p} i{j} ON i{j}.id = t.c_custkey" for j, p in enumerate(parts))
    return f"SELECT t.c_custkey, {pick} FROM customer_gaps t {joins}"


@register("knn_impute", sql=sql("customer_gaps") + "SELECT * FROM (" + _knn_sql() + ")", sig_cols=_KNN_COLS)
def knn_impute(spark, sf):
    return neighbours.knn_impute(frame(spark, sf, "customer_gaps"), _KNN_COLS, key="c_custkey")


# --- distribution fitting ---

_FIT_COLS = ["l_quantity", "l_extendedprice"]
_FIT_SQL = "\nUNION ALL\n".join(f"""SELECT '{c}' AS column_name, family, parameter1, parameter2, n, log_likelihood, aic FROM (
  WITH s AS (SELECT count({c}) AS n, avg({c}) AS m, stddev_pop({c}) AS sd, avg(ln({c})) AS ml, stddev_pop(ln({c})) AS sl FROM lineitem),
  f AS (SELECT n, 'normal' AS family, m AS parameter1, sd AS parameter2, -n / 2.0 * (ln(2 * pi() * sd * sd) + 1) AS ll FROM s
    UNION ALL SELECT n, 'exponential', 1 / m, NULL, -n * (ln(m) + 1) FROM s
    UNION ALL SELECT n, 'lognormal', ml, sl, -n * (ml + 0.5 * (ln(2 * pi() * sl * sl) + 1)) FROM s)
  SELECT *, ll AS log_likelihood, 2.0 * (CASE family WHEN 'exponential' THEN 1 ELSE 2 END) - 2 * ll AS aic FROM f)""" for c in _FIT_COLS)


@register("fit_closed", sql=_FIT_SQL, sig_cols=["parameter1", "parameter2", "log_likelihood", "aic"])
def fit_closed(spark, sf):
    """The families whose parameters are moments."""
    return fitting.fit_distributions(frame(spark, sf, "lineitem"), _FIT_COLS, ("normal", "exponential", "lognormal"),
                                     with_ks=False).drop("rank", "ks")


@register("fit_distributions")
def fit_distributions(spark, sf):
    return fitting.fit_distributions(frame(spark, sf, "lineitem"), _FIT_COLS)


# --- Tukey ---

_TUKEY = """WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS s FROM customer GROUP BY 1),
t AS (SELECT CAST(sum(n) - count(*) AS BIGINT) AS dfw, sum((n - 1) * s) AS ssw FROM g)
SELECT a.g AS group1, b.g AS group2, a.n AS n1, b.n AS n2, b.m - a.m AS difference,
  abs(b.m - a.m) / sqrt(ssw / dfw / 2 * (1.0 / a.n + 1.0 / b.n)) AS statistic, dfw AS df_within
FROM g a JOIN g b ON a.g < b.g, t"""


@register("tukey_statistic", sql=_TUKEY, sig_cols=["difference", "statistic"])
def tukey_statistic(spark, sf):
    return tukey.tukey_pairs(frame(spark, sf, "customer"), "c_mktsegment", "c_acctbal", with_p=False)


@register("tukey_pairs")
def tukey_pairs(spark, sf):
    return tukey.tukey_pairs(frame(spark, sf, "customer"), "c_mktsegment", "c_acctbal")


# --- PACF and forecasts ---

_PACF = sql("events_daily") + """, p AS (SELECT series, v - avg(v) OVER (PARTITION BY series) AS d, count(*) OVER (PARTITION BY series) AS n,
  row_number() OVER (PARTITION BY series ORDER BY bucket) AS pos FROM events_daily),
c AS (SELECT a.series, a.n, b.pos - a.pos AS lag, sum(a.d * b.d) AS num FROM p a JOIN p b ON a.series = b.series AND b.pos - a.pos BETWEEN 0 AND 3
  WHERE a.n > 10 GROUP BY 1, 2, 3),
r AS (SELECT series, n, max(num) FILTER (lag = 1) / max(num) FILTER (lag = 0) AS r1, max(num) FILTER (lag = 2) / max(num) FILTER (lag = 0) AS r2,
  max(num) FILTER (lag = 3) / max(num) FILTER (lag = 0) AS r3 FROM c GROUP BY 1, 2),
o AS (SELECT series, n, 1 AS lag, r1 AS pacf FROM r
  UNION ALL SELECT series, n, 2, (r2 - r1 * r1) / (1 - r1 * r1) FROM r
  UNION ALL SELECT series, n, 3, (r1 * r1 * r1 - r1 * r2 * (2 - r2) + r3 * (1 - r1 * r1)) / (1 - r2 * r2 - 2 * r1 * r1 * (1 - r2)) FROM r)
SELECT series, lag, pacf, n, abs(pacf) > 2 / sqrt(n) AS significant FROM o"""


@register("ts_pacf_first", sql=_PACF, sig_cols=["pacf"])
def ts_pacf_first(spark, sf):
    return forecast.ts_pacf(frame(spark, sf, "events_daily"), 3)


@register("ts_pacf")
def ts_pacf(spark, sf):
    return forecast.ts_pacf(frame(spark, sf, "orders_weekly"))


_HOLT = sql("events_daily").replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT series, v,
  row_number() OVER (PARTITION BY series ORDER BY bucket) AS i, count(*) OVER (PARTITION BY series) AS n FROM events_daily),
h AS (SELECT a.series, a.v AS l, b.v - a.v AS t FROM p a JOIN p b ON a.series = b.series AND a.i = 1 AND b.i = 2),
s AS (SELECT series, CAST(0 AS BIGINT) AS i, l, t, CAST(0.0 AS DOUBLE) AS sse FROM h
  UNION ALL SELECT s.series, p.i, s.l + s.t + 0.3 * (p.v - s.l - s.t), s.t + 0.3 * 0.1 * (p.v - s.l - s.t),
    s.sse + (p.v - s.l - s.t) * (p.v - s.l - s.t) FROM s JOIN p ON p.series = s.series AND p.i = s.i + 1)
SELECT s.series, CAST(step AS INTEGER) AS step, l + step * t AS forecast, sse, n
FROM s JOIN (SELECT DISTINCT series, n FROM p) USING (series), (SELECT unnest(range(1, 13)) AS step) WHERE s.i = n"""


@register("ts_forecast_fixed", sql=_HOLT, sig_cols=["forecast", "sse"])
def ts_forecast_fixed(spark, sf):
    """Level and trend with given parameters."""
    return forecast.forecast(frame(spark, sf, "events_daily"), params=[(0.3, 0.1, 0.0)]).select(
        "series", "step", "forecast", "sse", "n")


@register("ts_forecast")
def ts_forecast(spark, sf):
    return forecast.forecast(frame(spark, sf, "orders_weekly"), period=12)
