"""Operators on hand-made frames: gates, ties, edge cases (FIXTURES section 3)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statloom.operators import correlate as R
from statloom.operators import describe as D
from statloom.operators import hypothesis as H
from statloom.operators import prepare as C
from statloom.operators import profile as P
from statloom.operators import timeseries as TS


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(v,) for v in "aabbc"], "c string")
    r = D.describe_categorical(df).first()
    assert r.mode == "a" and r.mode_freq == 2 and r.n_distinct == 3
    assert math.isclose(r.entropy, -(2 * 0.4 * math.log(0.4) + 0.2 * math.log(0.2)))


def test_null_share_gates_are_strict(spark):
    rows = [(i, None if i < 10 else 1.0, None if i < 19 else 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    out = C.impute_median(df, ["a", "b"])
    assert out.filter(F.col("a").isNull()).count() == 0      # exactly 50 % -> imputed
    assert out.filter(F.col("b").isNull()).count() == 19     # 95 % -> left alone
    assert C.drop_sparse_columns(df).columns == ["id", "a", "b"]   # 0.95 is not > 0.95


def test_levels_dispatch(spark):
    rows = [(f"x{i % 2}", f"y{i % 9}", f"z{i % 10}", None if i == 0 else "only") for i in range(40)]
    df = spark.createDataFrame(rows, "k2 string, k9 string, k10 string, k1 string")
    enc = C.categorical_features(df, "k2")
    assert set(r.k2_encoded for r in enc.collect()) == {0, 1}
    oh = C.categorical_features(df, "k9")
    assert sum(c.startswith("k9_") for c in oh.columns) == 8
    fq = C.categorical_features(df, "k10")
    assert "k10_freq" in fq.columns
    one = C.one_hot(df, "k1")
    assert one.columns == df.columns  # one level -> no indicator


def test_label_encoding_null_is_third_class(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    r = {x.c: x.c_encoded for x in C.label_encode_binary(df, "c").collect()}
    assert r == {"a": 0, "b": 1, None: 2}   # 'mancante' sorts after 'b'


def test_skew_gate(spark):
    base = [1.0] * 50 + [100.0]
    df = spark.createDataFrame([(v, v - 1.0, v - 2.0) for v in base], "pos double, zero double, neg double")
    out = C.skew_transform(df)
    assert "pos_log" in out.columns and "zero_sqrt" in out.columns
    assert not any(c.startswith("neg_") for c in out.columns)


def test_ffill_bfill_global_matches_pandas(spark):
    vals = [None, None, 1.0, None, 3.0, None, None, 7.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k long, v double").repartition(3)
    got = [r.v for r in C.fill_ffill_bfill(df, "v", ["k"]).orderBy("k").collect()]
    exp = pd.Series(vals).ffill().bfill().tolist()
    assert got == exp


def test_validate_empty_and_duplicates(spark):
    empty = spark.createDataFrame([], "a long, b string")
    r = P.validate_table(empty).collect()
    assert [(x.level, x.rule) for x in r] == [("error", "empty_table")]
    df = spark.createDataFrame([(1, "1"), (1, "2")], "a long, b string")
    rules = {(x.rule, x.column_name) for x in P.validate_table(df).collect()}
    assert ("constant", "a") in rules and ("numeric_text", "b") in rules


def test_category_rules(spark):
    df = spark.createDataFrame([(i, i * 1.5, f"t{i}", "x", i % 3) for i in range(100)],
                               "order_id long, unit_price double, note string, flag string, rating int")
    cats = {r.column_name: r.category for r in P.column_categories(df).collect()}
    assert cats == {"order_id": "identifier", "unit_price": "currency", "note": "text",
                    "flag": "category", "rating": "category"}


def test_line_trend_and_seasonality(spark):
    rows = [("s", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), 2.0 * i + 1) for i in range(30)]
    ser = spark.createDataFrame(rows, "series string, bucket timestamp, v double")
    t = TS.ts_trend(ser).first()
    assert math.isclose(t.slope, 2.0) and math.isclose(t.r2, 1.0) and t.strength == "strong"
    sine = [("s", (pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)).to_pydatetime(), math.sin(2 * math.pi * i / 7))
            for i in range(56)]
    st_ = TS.ts_strength(spark.createDataFrame(sine, "series string, bucket timestamp, v double"), 7).first()
    assert st_.has_seasonality
    acf = {r.lag: r.acf for r in TS.ts_acf(spark.createDataFrame(sine, "series string, bucket timestamp, v double")).collect()}
    assert acf[7] > 0.8


def test_adf_distinguishes_random_walk():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=300)
    assert TS.adf_test(noise)["p_value"] < 0.01
    assert TS.adf_test(np.cumsum(noise))["p_value"] > 0.05
    crit = TS.mackinnon_crit(300)
    assert crit["1%"] < crit["5%"] < crit["10%"] < 0


def test_shapiro_wilk_behaviour():
    rng = np.random.default_rng(3)
    w_norm, p_norm = H.shapiro_wilk(rng.normal(size=200))
    w_exp, p_exp = H.shapiro_wilk(rng.exponential(size=200))
    assert 0.97 < w_norm <= 1.0 and p_norm > 0.01
    assert w_exp < 0.95 and p_exp < 1e-4


def test_spearman_with_ties_matches_pandas(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 5, 200)
    y = x + rng.integers(0, 3, 200)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    r = R.corr_spearman(df, ["x", "y"]).first().r
    exp = pd.Series(x).rank().corr(pd.Series(y).rank())  # spearman = pearson on average ranks
    assert math.isclose(r, exp, rel_tol=1e-9)


def test_pearson_pairwise_complete(spark):
    rows = [(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 8.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = R.corr_pearson(df).first()
    exp = pd.DataFrame(rows, columns=["a", "b"]).corr().loc["a", "b"]
    assert r.n == 3 and math.isclose(r.r, exp)


def test_mann_whitney_matches_formula(spark):
    a = [1.0, 2.0, 3.0, 4.0, 10.0]
    b = [2.0, 5.0, 6.0, 7.0, 8.0]
    df = spark.createDataFrame(list(zip(a, b)), "a double, b double")
    r = H.mann_whitney(df, ["a", "b"]).first()
    ranks = pd.Series(a + b).rank()
    u1 = ranks[:5].sum() - 15
    assert math.isclose(r.statistic, u1)


def test_pca_matches_numpy_eigh(spark):
    from statloom.operators import multivariate as M
    rng = np.random.default_rng(5)
    a = rng.normal(size=300)
    data = np.column_stack([a, a + rng.normal(scale=0.5, size=300), rng.normal(size=300)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "x double, y double, z double")
    out = M.pca(df, ["x", "y", "z"])
    var = out["pca_variance"].orderBy("component").collect()
    z = (data - data.mean(0)) / data.std(0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    assert np.allclose([r.eigenvalue for r in var], ev, rtol=1e-8)
    assert math.isclose(var[-1].cumulative, 1.0)


def test_engine_analyze_runs(spark):
    from statloom.operators.prepare import AnalysisParams
    from statloom.plans.engine import analyze
    from tests.conftest import SF
    ev = spark.read.parquet(f"{SF}/events.parquet").drop("props")
    res = analyze(ev, AnalysisParams(analysis_types=("descriptive", "correlations", "outliers", "time_series")),
                  key="event_id")
    assert {"descriptive_numeric", "outliers_iqr", "ts_trend"} <= set(res)
    assert res["descriptive_numeric"].count() == 2


@pytest.mark.parametrize("cells_per_block", [10**9, 7])
def test_kendall_matches_brute_force(spark, cells_per_block):
    import collections
    from statloom.operators.kendall import corr_kendall
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, 120).astype(float)
    y = (x + rng.integers(0, 4, 120)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    tau = corr_kendall(df, ["x", "y"], cells_per_block=cells_per_block).first().tau
    n = len(x)
    s = sum(np.sum(np.sign(x[i] - x[i + 1:]) * np.sign(y[i] - y[i + 1:])) for i in range(n))
    n0 = n * (n - 1) / 2
    t1 = sum(v * (v - 1) / 2 for v in collections.Counter(x).values())
    t2 = sum(v * (v - 1) / 2 for v in collections.Counter(y).values())
    assert math.isclose(tau, s / math.sqrt((n0 - t1) * (n0 - t2)), rel_tol=1e-12)


def test_isolation_forest_and_full_analysis_use_every_core(spark):
    """A table read in one task is scored and analysed on every core."""
    from statloom.operators.iforest import isolation_scores
    from statloom.operators.prepare import AnalysisParams
    from statloom.plans.engine import full_analysis
    df = spark.range(2000, numPartitions=1).selectExpr("id", "cast(id % 97 as double) AS a", "cast(id * id % 101 as double) AS b")
    cores = spark.sparkContext.defaultParallelism
    assert isolation_scores(df, "id", trees=5).rdd.getNumPartitions() >= cores
    done = full_analysis(df, AnalysisParams(analysis_types=("descriptive",)), key="id")["processed"]
    assert done.rdd.getNumPartitions() >= cores and done.count() == 2000


def test_path_lengths_walk_like_single_rows():
    from statloom.operators import iforest
    rng = np.random.default_rng(3)
    nodes = pd.DataFrame(iforest._grow(rng.normal(size=(64, 3)), rng, 6),
                         columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
    x = np.vstack([rng.normal(size=(50, 3)) * 2, [[np.inf, -np.inf, 0.0]]])

    def walk(row):
        n = nodes.iloc[0]
        while n.feature >= 0:
            n = nodes.iloc[int(n.left if row[int(n.feature)] < n.threshold else n.right)]
        return n.depth + iforest.c_factor(n["size"])

    assert np.allclose(iforest._path_lengths(x, iforest._tree(nodes)), [walk(r) for r in x], rtol=0, atol=0)


def test_isolation_forest_finds_planted_outliers(spark):
    from statloom.operators.iforest import isolation_scores, outliers_isolation_forest
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(size=(450, 2)), rng.normal(9, 0.5, size=(20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "id long, a double, b double")
    s = isolation_scores(df, "id", trees=30).toPandas().sort_values("score")
    assert s.head(20)["id"].ge(450).mean() >= 0.9
    summ = outliers_isolation_forest(df, "id", trees=30)["summary"].first()
    assert summ.n == 470 and summ.n_outliers == 47


def _naive_dbscan(z, eps=0.5, min_samples=5):
    n = len(z)
    dist = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(-1))
    nb = dist <= eps
    core = nb.sum(1) >= min_samples
    lab = -np.ones(n, int)
    c = 0
    for i in range(n):
        if not core[i] or lab[i] != -1:
            continue
        stack, lab[i] = [i], c
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(nb[j]):
                if lab[k] == -1 or (core[k] and lab[k] != c and lab[k] == -1):
                    lab[k] = c
                    if core[k]:
                        stack.append(k)
        c += 1
    return c, int((lab == -1).sum()), int(core.sum())


def test_dbscan_matches_naive(spark):
    from statloom.operators.dbscan import dbscan_summary
    rng = np.random.default_rng(11)
    t = np.linspace(0, 6, 150)
    chain = np.column_stack([t, np.sin(t)]) + rng.normal(0, 0.03, (150, 2))
    blob = rng.normal((8, -3), 0.2, (80, 2))
    noise = rng.uniform(-10, 15, (30, 2))
    pts = np.vstack([chain, blob, noise])
    df = spark.createDataFrame([tuple(map(float, r)) for r in pts], "x double, y double")
    s = dbscan_summary(df, ["x", "y"])["summary"].first()
    z = (pts - pts.mean(0)) / pts.std(0)
    c, noise_n, core_n = _naive_dbscan(z)
    assert (s.n_clusters, s.n_noise, s.n_core) == (c, noise_n, core_n)


def test_kmeans_sweep_finds_three_blobs(spark):
    from statloom.operators import multivariate as M
    rng = np.random.default_rng(8)
    pts = np.vstack([rng.normal(c, 0.1, (40, 2)) for c in [(0, 0), (5, 5), (0, 5)]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in pts], "x double, y double")
    sweep = M.kmeans_sweep(df, ["x", "y"], k_range=range(2, 5), restarts=2).collect()
    best = [r.k for r in sweep if r.is_best]
    assert best == [3]
    prof = M.kmeans_profile(df, 3, ["x", "y"], restarts=2).collect()
    assert sorted(r.size for r in prof) == [40, 40, 40]


def test_sparse_dbscan_meets_in_units(spark, monkeypatch):
    import numpy as np

    from statloom.operators import dbscan as D
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 5))
    x[:40] = x[0] + rng.normal(size=(40, 5)) * 0.3
    x[40:60] = x[41]
    monkeypatch.setattr(D, "UNIT_ROWS", (40, 60))
    monkeypatch.setattr(D, "_cell_pairs", None)  # no pairs of cells where hardly two points share one
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double, e double")
    got = D.dbscan_labels(df, eps=1.0).collect()
    z = (x - x.mean(0)) / x.std(0)
    near = ((z[:, None] - z[None]) ** 2).sum(2) <= 1.0
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(z)), len(z))
    while True:
        low = np.where(core, np.where(near & core, label, len(z)).min(1), len(z))
        if (low == label).all():
            break
        label = low
    noise = ~(near & core).any(1)
    assert sum(r.w for r in got) == 700
    assert sum(r.w for r in got if r.core) == core.sum() and sum(r.w for r in got if r.label == -1) == noise.sum()
    parts = {}
    for r in got:
        if r.core:
            i = int(((z - [r.a, r.b, r.c, r.d, r.e]) ** 2).sum(1).argmin())
            parts.setdefault(r.label, set()).add(label[i])
    assert all(len(v) == 1 for v in parts.values()) and len(parts) == len(set(label[core]))


def test_close_is_exact_at_eps():
    import numpy as np

    from statloom.operators import dbscan as D
    rng = np.random.default_rng(5)
    x = rng.integers(-8, 8, (300, 4)) * 0.1 + 1000.0
    for eps in (0.1, 0.3, 0.5):
        assert (D._close(x, x, eps) == D._within(x, x, eps)).all()
    part = D._own_components(np.array([[0.0], [5.0], [0.4], [0.8], [5.3]]), 0.5)
    assert part.tolist() == [0, 1, 0, 0, 1]
    a, y = np.array([[0.0], [0.2], [9.0]]), np.array([[9.3], [0.3], [30.0]])
    assert D._linked_parts(a, np.array([7, 7, 8]), y, np.array([3, 4, 5]), 0.5).tolist() == [[7, 4], [8, 3]]


def test_distinct_counts_bound_the_rows_of_a_task(spark, monkeypatch):
    from statloom.operators import profile as P
    df = spark.createDataFrame([(i, float(i % 7), None if i % 3 else "t") for i in range(400)], "k long, v double, s string").coalesce(1)
    monkeypatch.setattr(P, "TASK_ROWS", 20)
    got = P.column_digest(df)
    assert "Repartition 20, true" in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.column_name: (r.n_distinct, round(r.pct_nulls, 3)) for r in got.collect()} == {
        "k": (400, 0.0), "v": (7, 0.0), "s": (1, 66.5)}
