"""Registered queries: normality, hypothesis tests, feature relevance."""

from __future__ import annotations

from statloom.functions.exprs import norm_cdf_sql
from statloom.operators import hypothesis as H
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql

EV = ["event_id", "user_id", "value"]


def _u(parts):
    return "\nUNION ALL\n".join(parts)


def _dag_sql(src, c):
    n, g1, b2 = "n", "g1", "b2"
    y0 = f"({g1} * sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2))))"
    beta2 = "(3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))"
    w2 = f"(-1.0 + sqrt(2.0 * ({beta2} - 1.0)))"
    delta = f"(1.0 / sqrt(0.5 * ln({w2})))"
    alpha = f"sqrt(2.0 / ({w2} - 1.0))"
    y = f"(CASE WHEN {y0} = 0 THEN 1.0 ELSE {y0} END)"
    ya = f"({y} / {alpha})"
    z1 = f"({delta} * ln({ya} + sqrt({ya} * {ya} + 1.0)))"
    e = "(3.0 * (n - 1) / (n + 1))"
    varb2 = "(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))"
    x = f"(({b2} - {e}) / sqrt({varb2}))"
    sb1 = "(6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))"
    a = f"(6.0 + 8.0 / {sb1} * (2.0 / {sb1} + sqrt(1.0 + 4.0 / ({sb1} * {sb1}))))"
    term1 = f"(1.0 - 2.0 / (9.0 * {a}))"
    denom = f"(1.0 + {x} * sqrt(2.0 / ({a} - 4.0)))"
    term2 = f"(sign({denom}) * pow((1.0 - 2.0 / {a}) / abs({denom}), 1.0 / 3.0))"
    z2 = f"(({term1} - {term2}) / sqrt(2.0 / (9.0 * {a})))"
    k2 = f"({z1} * {z1} + {z2} * {z2})"
    return (f"SELECT '{c}' AS column_name, CAST(n AS BIGINT) AS n, 'dagostino_pearson' AS test, {k2} AS statistic, "
            f"exp(-{k2} / 2.0) AS p_value, exp(-{k2} / 2.0) > 0.05 AS is_normal FROM ("
            f"SELECT CAST(count(*) AS DOUBLE) AS n, avg(pow(x - m, 3)) / pow(avg(pow(x - m, 2)), 1.5) AS g1, "
            f"avg(pow(x - m, 4)) / pow(avg(pow(x - m, 2)), 2) AS b2 FROM "
            f"(SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m FROM {src} WHERE {c} IS NOT NULL)) "
            f"WHERE n > 20")


@register("normality_dagostino", sql=_u([_dag_sql("events", c) for c in EV]), sig_cols=["statistic", "p_value"])
def normality_dagostino(spark, sf):
    return H.normality_dagostino(frame(spark, sf, "events"), EV)


def _tail_sql(z):
    from statloom.functions.exprs import _AS_B, _AS_P, _INV_SQRT_2PI
    b = _AS_B
    t = f"(1.0 / (1.0 + {_AS_P} * abs({z})))"
    poly = f"({t} * ({b[0]} + {t} * ({b[1]} + {t} * ({b[2]} + {t} * ({b[3]} + {t} * {b[4]})))))"
    tail = f"({_INV_SQRT_2PI} * exp(-abs({z}) * abs({z}) / 2.0) * {poly})"
    small = f"greatest({tail}, 1e-300)"
    big = f"least(1.0 - {tail}, 1.0 - 1e-16)"
    return (f"ln(CASE WHEN {z} < 0 THEN {small} ELSE {big} END)",
            f"ln(CASE WHEN {z} > 0 THEN {small} ELSE {big} END)")


def _ad_sql(src, c):
    z = "((x - m) / s)"
    lnf, lnsf = _tail_sql(z)
    return (f"SELECT '{c}' AS column_name, CAST(n AS BIGINT) AS n, -n - sum((2 * i - 1) * {lnf} + (2 * n - 2 * i + 1) * {lnsf}) / n AS statistic, "
            + ", ".join(f"round({v} / (1.0 + 4.0 / n - 25.0 / (n * n)), 3) AS crit_{str(l).replace('.', '_')}"
                        for v, l in zip(H.AD_BASE, H.AD_LEVELS))
            + f" FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m, "
            f"stddev_samp(CAST({c} AS DOUBLE)) OVER () AS s, CAST(count(*) OVER () AS DOUBLE) AS n, "
            f"row_number() OVER (ORDER BY {c}) AS i FROM {src} WHERE {c} IS NOT NULL) WHERE n > 20 GROUP BY n")


@register("normality_anderson", sql=_u([_ad_sql("events", c) for c in EV]), sig_cols=["statistic"])
def normality_anderson(spark, sf):
    return H.normality_anderson(frame(spark, sf, "events"), EV)


def _ks_sql(src, c):
    f = norm_cdf_sql("((x - m) / s)")
    return (f"SELECT '{c}' AS column_name, CAST(n AS BIGINT) AS n, max(greatest(i / n - {f}, {f} - (i - 1) / n)) AS statistic "
            f"FROM (SELECT CAST({c} AS DOUBLE) AS x, avg(CAST({c} AS DOUBLE)) OVER () AS m, "
            f"stddev_samp(CAST({c} AS DOUBLE)) OVER () AS s, CAST(count(*) OVER () AS DOUBLE) AS n, "
            f"row_number() OVER (ORDER BY {c}) AS i FROM {src} WHERE {c} IS NOT NULL) WHERE n > 20 GROUP BY n")


@register("normality_ks", sql=_u([_ks_sql("events", c) for c in EV]), sig_cols=["statistic"])
def normality_ks(spark, sf):
    return H.normality_ks(frame(spark, sf, "events"), EV, with_p=False)


@register("normality_shapiro")
def normality_shapiro(spark, sf):
    return H.normality_shapiro(frame(spark, sf, "documents"), ["n_chars"]).unionByName(
        H.normality_shapiro(frame(spark, sf, "customer"), ["c_acctbal", "c_nationkey"]))


@register("normality_tests")
def normality_tests(spark, sf):
    return H.normality_tests(frame(spark, sf, "events"), EV)


@register("distribution_traits")
def distribution_traits(spark, sf):
    return H.distribution_traits(frame(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])


_PAIRS = [("event_id", "user_id"), ("event_id", "value"), ("user_id", "value")]


@register("t_test_pairs", sql="WITH st AS (" + _u([
    f"SELECT '{c}' AS c, CAST(count({c}) AS DOUBLE) AS n, avg({c}) AS m, var_samp({c}) AS v FROM events" for c in EV]) + ")\n" + _u([
    f"SELECT '{a}' AS var1, '{b}' AS var2, 't_test' AS test, (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS statistic, "
    f"a.n + b.n - 2 AS df, (a.m - b.m) / sqrt((a.v + b.v) / 2.0) AS effect_size FROM st a, st b WHERE a.c = '{a}' AND b.c = '{b}'"
    for a, b in _PAIRS]), sig_cols=["statistic", "effect_size"])
def t_test_pairs(spark, sf):
    return H.t_test_pairs(frame(spark, sf, "events"), EV, with_p=False)


def _mw_sql(a, b):
    return (f"SELECT '{a}' AS var1, '{b}' AS var2, 'mann_whitney' AS test, r1 - n1 * (n1 + 1) / 2.0 AS statistic, "
            f"(greatest(r1 - n1 * (n1 + 1) / 2.0, n1 * n2 - (r1 - n1 * (n1 + 1) / 2.0)) - n1 * n2 / 2.0 - 0.5) / "
            f"sqrt(n1 * n2 / 12.0 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM ("
            f"SELECT sum(CASE WHEN s = 1 THEN rk END) AS r1, CAST(sum(s) AS DOUBLE) AS n1, CAST(count(*) - sum(s) AS DOUBLE) AS n2, "
            f"(SELECT sum(pow(c, 3) - c) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM (SELECT CAST({a} AS DOUBLE) AS x FROM events "
            f"UNION ALL SELECT CAST({b} AS DOUBLE) FROM events) GROUP BY x)) AS ties FROM ("
            f"SELECT s, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM ("
            f"SELECT CAST({a} AS DOUBLE) AS x, 1 AS s FROM events UNION ALL SELECT CAST({b} AS DOUBLE), 0 FROM events)))")


@register("mann_whitney", sql=_u([_mw_sql(a, b) for a, b in _PAIRS]), sig_cols=["statistic", "z"])
def mann_whitney(spark, sf):
    return H.mann_whitney(frame(spark, sf, "events"), EV, with_p=False)


@register("compare_pairs")
def compare_pairs(spark, sf):
    return H.compare_pairs(frame(spark, sf, "events"), EV)


_MIX_NUM = ["c_custkey", "c_acctbal", "c_nationkey"]


def _anova_sql(num):
    return (f"SELECT 'c_mktsegment' AS categorical, '{num}' AS numeric, (ssb / (k - 1)) / (ssw / (nn - k)) AS statistic, "
            f"k - 1 AS df_between, nn - k AS df_within, CAST(k AS BIGINT) AS n_groups FROM ("
            f"SELECT CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS nn, sum(n * pow(m - gm, 2)) AS ssb, "
            f"sum((n - 1) * coalesce(v, 0)) AS ssw FROM (SELECT *, sum(s) OVER () / sum(n) OVER () AS gm FROM ("
            f"SELECT c_mktsegment, count(*) AS n, sum(CAST({num} AS DOUBLE)) AS s, avg(CAST({num} AS DOUBLE)) AS m, "
            f"var_samp(CAST({num} AS DOUBLE)) AS v FROM customer_mix WHERE c_mktsegment IS NOT NULL AND {num} IS NOT NULL "
            f"GROUP BY 1 HAVING count(*) > 5))) WHERE k >= 2")


@register("anova_oneway", sql=sql("customer_mix") + _u([_anova_sql(c) for c in _MIX_NUM]), sig_cols=["statistic"])
def anova_oneway(spark, sf):
    return H.anova_oneway(frame(spark, sf, "customer_mix"), ["c_mktsegment"], _MIX_NUM, with_p=False)


_ROLL = ["n_lines", "sum_qty", "sum_price", "avg_disc"]


@register("importance_correlation", sql=sql("order_rollup") + _u([
    f"SELECT '{f}' AS feature, 'avg_disc' AS target, count(*) AS n, abs(corr({f}, avg_disc)) AS abs_r, "
    f"corr({f}, avg_disc) * sqrt((count(*) - 2) / (1 - corr({f}, avg_disc) * corr({f}, avg_disc))) AS t_stat FROM order_rollup"
    for f in _ROLL[:-1]]), sig_cols=["abs_r", "t_stat"])
def importance_correlation(spark, sf):
    return H.importance_correlation(frame(spark, sf, "order_rollup"), _ROLL, with_p=False)


def _bin_sql(c):
    return " + ".join(f"CASE WHEN {c} > (SELECT quantile_cont({c}, {i / 10}) FROM order_rollup) THEN 1 ELSE 0 END"
                      for i in range(1, 10))


_MI_SQL = sql("order_rollup") + "SELECT * FROM (WITH b AS (SELECT " + ", ".join(
    f"{_bin_sql(c)} AS {c}" for c in _ROLL) + " FROM order_rollup),\nmi AS (" + _u([
    f"SELECT '{f}' AS feature, 'avg_disc' AS target, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM ("
    f"SELECT nxy, sum(nxy) OVER (PARTITION BY bx) AS nx, sum(nxy) OVER (PARTITION BY by_) AS ny, sum(nxy) OVER () AS n FROM ("
    f"SELECT {f} AS bx, avg_disc AS by_, CAST(count(*) AS DOUBLE) AS nxy FROM b GROUP BY 1, 2))"
    for f in _ROLL[:-1]]) + ")\nSELECT feature, target, mi, CASE WHEN max(mi) OVER () > 0 THEN mi / max(mi) OVER () ELSE mi END AS mi_norm FROM mi)"


@register("mutual_information", sql=_MI_SQL, sig_cols=["mi", "mi_norm"])
def mutual_information(spark, sf):
    return H.mutual_information(frame(spark, sf, "order_rollup"), _ROLL)


@register("chi_square", sql="""SELECT 'l_returnflag' AS var1, 'l_linestatus' AS var2, sum(o * o * n / (ra * cb)) - n AS statistic,
  CAST((ka - 1) * (kb - 1) AS DOUBLE) AS df FROM (
  SELECT o, sum(o) OVER (PARTITION BY l_returnflag) AS ra, sum(o) OVER (PARTITION BY l_linestatus) AS cb,
    sum(o) OVER () AS n, (SELECT count(DISTINCT l_returnflag) FROM lineitem) AS ka,
    (SELECT count(DISTINCT l_linestatus) FROM lineitem) AS kb
  FROM (SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS o FROM lineitem GROUP BY 1, 2)) GROUP BY n, ka, kb""",
          sig_cols=["statistic"])
def chi_square(spark, sf):
    return H.chi_square(frame(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", with_p=False)


@register("kruskal_wallis", sql="""SELECT 'c_mktsegment' AS "group", 'c_acctbal' AS value,
  (12.0 / (nn * (nn + 1)) * s - 3 * (nn + 1)) / (1 - t / (nn * nn * nn - nn)) AS statistic, CAST(k - 1 AS DOUBLE) AS df FROM (
  SELECT sum(rs * rs / ni) AS s, CAST(max(nn) AS DOUBLE) AS nn, count(*) AS k,
    (SELECT sum(pow(c, 3) - c) FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM customer GROUP BY c_acctbal)) AS t FROM (
  SELECT c_mktsegment, sum(rk) AS rs, count(*) AS ni, max(nn) AS nn FROM (
    SELECT c_mktsegment, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rk,
      count(*) OVER () AS nn FROM customer) GROUP BY 1))""", sig_cols=["statistic"])
def kruskal_wallis(spark, sf):
    return H.kruskal_wallis(frame(spark, sf, "customer"), "c_mktsegment", "c_acctbal", with_p=False)


def _qq_sql(c):
    from statloom.functions.special import norm_ppf
    probs = [i / 100 for i in range(1, 100)]
    pl = "[" + ", ".join(repr(p) for p in probs) + "]"
    zl = "[" + ", ".join(repr(norm_ppf(p)) for p in probs) + "]"
    x = f"CAST({c} AS DOUBLE)"
    return (f"SELECT '{c}' AS column_name, prob, sample_q, m + s * z AS normal_q FROM ("
            f"SELECT unnest({pl}) AS prob, unnest(quantile_cont({x}, {pl})) AS sample_q, unnest({zl}) AS z, "
            f"avg({x}) AS m, stddev_samp({x}) AS s FROM events)")


@register("qq_normal", sql=_u([_qq_sql(c) for c in ["user_id", "value"]]), sig_cols=["prob", "sample_q", "normal_q"])
def qq_normal(spark, sf):
    return H.qq_normal(frame(spark, sf, "events"), ["user_id", "value"])
