"""Mixtures, hierarchy, factor analysis, distance correlation, encoding, imputation, fitting and forecasts against numpy."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions.spectral import top_eigen
from statloom.operators import distance, encode, factor, fitting, forecast, hierarchy, mixture, neighbours, tukey


# --- Gaussian mixture ---

def blobs(rng, n=600, d=3):
    centres = np.array([[0.0] * d, [6.0] * d, [0.0, 8.0, -6.0][:d]])
    which = rng.integers(0, 3, n)
    return centres[which] + rng.normal(size=(n, d)) * [[1.0], [0.5], [1.5]][0], which


def numpy_em(x, start, rounds):
    """Textbook EM, one density at a time."""
    w, m, c = (np.array(a) for a in start)
    history = []
    for _ in range(rounds):
        dens = np.stack([w[j] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m[j], np.linalg.inv(c[j]), x - m[j]))
                         / math.sqrt((2 * math.pi) ** x.shape[1] * np.linalg.det(c[j])) for j in range(len(w))], 1)
        history.append(np.log(dens.sum(1)).mean())
        r = dens / dens.sum(1, keepdims=True)
        w = r.mean(0)
        m = (r.T @ x) / r.sum(0)[:, None]
        c = np.stack([(r[:, j, None] * (x - m[j])).T @ (x - m[j]) / r[:, j].sum() + mixture.RIDGE * np.eye(x.shape[1])
                      for j in range(len(w))])
    return w, m, c, history


def test_mixture_equals_numpy_em(spark):
    x, _ = blobs(np.random.default_rng(1))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double").repartition(5)
    z = mixture.scaled(df, ["a", "b", "c"])
    held = np.array(z.collect())
    start = (np.full(3, 1 / 3), held[[0, 1, 2]], np.stack([np.eye(3)] * 3))
    got = mixture.fit(z, ["a", "b", "c"], 3, start=start, max_rounds=12, tolerance=-1.0)
    w, m, c, history = numpy_em(held, start, 12)
    assert np.allclose(got.history[:12], history, atol=1e-9)
    assert np.allclose(got.weights, w) and np.allclose(got.means, m) and np.allclose(got.covariances, c)
    assert all(b >= a - 1e-9 for a, b in zip(got.history, got.history[1:]))


def test_mixture_finds_blobs(spark):
    x, which = blobs(np.random.default_rng(2))
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [(-1, None, 1.0, 1.0)], "id long, a double, b double, c double")
    sweep = mixture.gmm_sweep(df, ["a", "b", "c"], (1, 3, 4)).collect()
    assert [r.k for r in sweep if r.is_best] == [3]
    lab = {r.id: r.component for r in mixture.gmm_labels(df, "id", 3).collect()}
    assert len(lab) == 600
    same = sum(len({lab[i] for i in np.flatnonzero(which == k)}) == 1 for k in range(3))
    assert same == 3
    comp = mixture.gmm_components(df, 3, ["a", "b", "c"]).where("variable = 'a'").collect()
    assert abs(sum(r.weight for r in comp) - 1) < 1e-9
    assert sorted(round(r.mean) for r in comp) == [0, 0, 6]
    assert mixture.gmm_components(df.limit(0), 2, ["a", "b", "c"]).count() == 0


# --- hierarchical clustering ---

def naive_heights(x):
    """Merge heights of single linkage: Kruskal over all pairs."""
    up = list(range(len(x)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    out = []
    for d, i, j in sorted((math.dist(x[i], x[j]), i, j) for i, j in itertools.combinations(range(len(x)), 2)):
        a, b = find(i), find(j)
        if a != b:
            up[a] = b
            out.append(d)
    return out


@pytest.mark.parametrize("d,one_task", [(1, 10 ** 6), (3, 60)])
def test_single_linkage_equals_all_pairs(spark, d, one_task):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(70, d)), 5 + 0.01 * rng.normal(size=(60, d)), [[40.0] * d] * 3]).round(3)
    df = spark.createDataFrame(x.tolist(), ", ".join(f"x{j} double" for j in range(d)))
    got = hierarchy.merge_heights(df, cell=30, block=8, one_task=one_task, scale=False).collect()
    heights = sorted(h for r in got for h in [r.height] * r.merges)
    assert np.allclose(heights, naive_heights(x.tolist()), atol=1e-9)


def test_hierarchy_cuts(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(50, 2)), [30, 0] + rng.normal(size=(30, 2)), [0, 90] + rng.normal(size=(20, 2))])
    df = spark.createDataFrame(x.tolist(), "x double, y double")
    assert [r["size"] for r in hierarchy.cluster_sizes(df, 3, scale=False).collect()] == [50, 30, 20]
    out = hierarchy.hierarchy(df, last=6, scale=False)
    merges = out["merges"].orderBy("step").collect()
    assert len(merges) == 6 and merges[-1]["size"] == 100 and merges[-1].n_clusters == 1
    assert {merges[-1].left_size, merges[-1].right_size} == {80, 20} and {merges[-2].left_size, merges[-2].right_size} == {50, 30}
    assert [r.height for r in merges] == sorted(r.height for r in merges)
    assert hierarchy.merge_heights(df.limit(1), scale=False).count() == 0
    assert hierarchy.hierarchy(df.limit(0))["summary"].first().n_rows == 0


def test_spanning_forest_ties():
    x = np.array([[0.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 1.0]])
    d = hierarchy._distances(x, x)
    np.fill_diagonal(d, np.inf)
    # a square: of four equal edges the last in the order of their ends is left out, wherever the tree begins
    assert sorted(tuple(sorted(e)) for e in hierarchy.spanning_forest(d)) == [(0, 1), (0, 2), (1, 3)]


def test_closest_of_facing_lines_reads_a_band(monkeypatch):
    rng = np.random.default_rng(5)
    x, y = (np.column_stack([np.full(3000, float(c)), rng.random(3000)]) for c in (0, 1))
    want, read = hierarchy._distances(x, y).min(), []
    full = hierarchy._distances
    monkeypatch.setattr(hierarchy, "_distances", lambda a, b: read.append(len(a) * len(b)) or full(a, b))
    assert hierarchy._closest(x, y) == want
    assert sum(read) < 3000 * 3000 / 10


def test_level_0_leaves_only_borders_to_the_rounds(spark):
    rng = np.random.default_rng(6)
    x = rng.random((3000, 2)).round(3).tolist()
    pts = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "pid long, x array<double>").dropDuplicates(["x"])
    rows = hierarchy._level_0(pts, 2, 2, 1 / 16).collect()
    labels, edges = [r for r in rows if r.d is None], [r for r in rows if r.d is not None]
    n = len({tuple(v) for v in x})
    assert len(labels) == n and len({r.a for r in labels}) == n
    assert len(edges) >= n - 1 and sum(r.rep < 0 for r in edges) < n / 5
    # an inner edge joins points of one rep, and as many as make its points a tree
    of = {r.a: r.b for r in labels}
    assert all(of[r.a] == of[r.b] == r.rep for r in edges if r.rep >= 0)
    assert sum(r.rep >= 0 for r in edges) == n - len(set(of.values()))


# --- factor analysis ---

def indicator_frame(rows, cats, nums):
    """The matrix that FAMD takes apart, with indicator columns."""
    cols = {}
    for c in nums:
        v = np.array([r[c] for r in rows], float)
        cols[c, None] = (v - v.mean()) / v.std()
    for c in cats:
        for lv in sorted({r[c] for r in rows}):
            g = np.array([r[c] == lv for r in rows], float)
            cols[c, lv] = (g - g.mean()) / math.sqrt(g.mean())
    return cols


def mixed_rows(rng, n, levels):
    return [{"a": float(rng.normal()), "b": float(rng.normal()), "k": f"l{rng.integers(levels)}", "m": f"m{int(rng.integers(3))}"}
            for _ in range(n)]


@pytest.mark.parametrize("dense", [10 ** 6, 0])
def test_famd_equals_numpy(spark, dense):
    rng = np.random.default_rng(4)
    rows = mixed_rows(rng, 300, 5)
    for r in rows:
        r["b"] += 2 * r["a"] + (r["k"] == "l1")
    df = spark.createDataFrame([(i, r["a"], r["b"], r["k"], r["m"]) for i, r in enumerate(rows)], "id long, a double, b double, k string, m string")
    out = factor.famd(df, ["a", "b"], ["k", "m"], key="id", dense=dense)
    cols = indicator_frame(rows, ["k", "m"], ["a", "b"])
    x = np.stack(list(cols.values()), 1)
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    values, vectors = values[::-1], vectors[:, ::-1]
    got = out["famd_inertia"].orderBy("component").collect()
    assert np.allclose([r.inertia for r in got], values[:len(got)] / values.sum(), atol=1e-8)
    scores = x @ vectors[:, :3]
    mine = np.array([[r.dim1, r.dim2, r.dim3] for r in out["famd_rows"].orderBy("id").collect()])
    assert mine.shape == (100, 3)
    assert np.allclose(np.abs(mine), np.abs(scores[:100]), atol=1e-6)
    corr = {(r.variable, r.level, r.component): r.correlation for r in out["famd_columns"].collect()}
    for j, (key, v) in enumerate(cols.items()):
        for d in range(3):
            assert abs(abs(corr[(*key, f"dim{d + 1}")]) - abs(np.corrcoef(v, scores[:, d])[0, 1])) < 1e-6


@pytest.mark.parametrize("dense", [10 ** 6, 0])
def test_mca_and_ca_equal_numpy(spark, dense):
    rng = np.random.default_rng(5)
    rows = mixed_rows(rng, 400, 6)
    for r in rows:
        r["m"] = r["m"] if rng.random() < 0.5 else f"m{int(r['k'][1]) % 3}"
    df = spark.createDataFrame([(r["k"], r["m"]) for r in rows] + [(None, "m1")], "k string, m string")
    x = np.stack(list(indicator_frame(rows, ["k", "m"], []).values()), 1)
    values = np.linalg.eigvalsh(x.T @ x / len(x))[::-1] / 2
    got = factor.mca(df, ["k", "m"], dense=dense)["mca_inertia"].orderBy("component").collect()
    assert np.allclose([r.eigenvalue for r in got], values[:len(got)], atol=1e-8)
    assert len(got) == 7 and abs(got[-1].cumulative - 1) < 1e-8
    ks, ms = sorted({r["k"] for r in rows}), sorted({r["m"] for r in rows})
    table = np.array([[sum(r["k"] == k and r["m"] == m for r in rows) for m in ms] for k in ks]) / len(rows)
    pr, pc = table.sum(1), table.sum(0)
    u, s, vt = np.linalg.svd((table - np.outer(pr, pc)) / np.sqrt(np.outer(pr, pc)))
    out = factor.ca(df, "k", "m", dense=dense)
    got = out["ca_inertia"].orderBy("component").collect()
    assert np.allclose([r.eigenvalue for r in got], s[:2] ** 2, atol=1e-8) and abs(got[-1].cumulative - 1) < 1e-7
    pts = {(r.side, r.level, r.component): r.coordinate for r in out["ca_points"].collect()}
    for i, k in enumerate(ks):
        for d in range(2):
            assert abs(abs(pts["row", k, d + 1]) - abs(u[i, d] * s[d] / math.sqrt(pr[i]))) < 1e-6


def test_famd_takes_many_levels(spark):
    rows = [(i, float(i % 17), f"v{i % 3_000}", f"w{i % 7}") for i in range(9_000)]
    df = spark.createDataFrame(rows, "id long, a double, k string, m string")
    got = factor.famd(df, ["a"], ["k", "m"], n_components=3, key="id")["famd_inertia"].collect()
    assert len(got) == 3 and got[0].inertia >= got[-1].inertia > 0


def test_top_eigen_of_empty_and_factor_cases(spark):
    nodes = spark.createDataFrame([], "i long, u double")
    values, vec = top_eigen(spark.createDataFrame([], "i long, j long, a double"), nodes, 3)
    assert len(values) == 0 and vec.count() == 0
    df = spark.createDataFrame([(None, None)], "k string, m string")
    assert factor.mca(df)["mca_inertia"].count() == 0
    assert factor.ca(df, "k", "m")["ca_inertia"].count() == 0


# --- distance correlation ---

def naive_dcor(x, y):
    a, b = (np.abs(v[:, None] - v[None]) for v in (x, y))
    a, b = (m - m.mean(0) - m.mean(1)[:, None] + m.mean() for m in (a, b))
    cov, vx, vy = (a * b).mean(), (a * a).mean(), (b * b).mean()
    return math.sqrt(cov), math.sqrt(cov / math.sqrt(vx * vy))


@pytest.mark.parametrize("per_block", [10 ** 6, 40, 7])
def test_distance_correlation_equals_all_pairs(spark, per_block):
    rng = np.random.default_rng(6)
    x = rng.normal(size=300).round(1)
    x[:100] = 0.5  # one value that a third of the rows share
    y = (x ** 2 + rng.normal(size=300) * 0.2).round(2)
    df = spark.createDataFrame([(float(a), float(b), 1.0) for a, b in zip(x, y)] + [(None, 1.0, 1.0)], "x double, y double, c double")
    got = {(r.var1, r.var2): r for r in distance.corr_distance(df, cells_per_block=per_block).collect()}
    cov, cor = naive_dcor(x, y)
    assert abs(got["x", "y"].dcor - cor) < 1e-9 and abs(got["x", "y"].dcov - cov) < 1e-9
    assert got["x", "y"].n == 300 and got["x", "c"].dcor is None and got["x", "c"].dcov == 0


# --- target encoding ---

def test_target_encoding_leaves_the_own_fold_out(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "a", "a", "b", None, f"x{i}"]), rng.choice([None, 1.0, 2.0, 5.0])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, c string, y double")
    fold = {r.id: r.f for r in df.select("id", encode.fold_of("id", 4).alias("f")).collect()}
    for hot in (0.001, 0.2, 2.0):
        got = {r.id: r.c_target for r in encode.target_encode(df, ["c"], "y", "id", folds=4, smoothing=3.0, hot=hot).collect()}
        assert len(got) == 200
        for i, c, _ in rows:
            rest = [(d, y) for j, d, y in rows if fold[j] != fold[i] and y is not None]
            mean = sum(y for _, y in rest) / len(rest)
            own = [y for d, y in rest if d == c]
            assert abs(got[i] - (sum(own) + 3 * mean) / (len(own) + 3)) < 1e-9
    none = df.withColumn("y", F.lit(None).cast("double"))
    assert encode.target_encode(none, ["c"], "y", "id").where("c_target IS NOT NULL").count() == 0


def test_mixture_sums_are_matrix_products(monkeypatch):
    rng = np.random.default_rng(6)
    x, r = rng.normal(size=(500, 4)), rng.random((500, 3))
    want = np.concatenate([[7.0 * 500], r.sum(0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x).ravel()])
    w, m, c = np.array([0.2, 0.0, 0.8]), rng.normal(size=(3, 4)), np.stack([np.cov(rng.normal(size=(4, 50)))] * 3)
    dens = np.stack([w[j] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m[j], np.linalg.inv(c[j]), x - m[j]))
                     / math.sqrt((2 * math.pi) ** 4 * np.linalg.det(c[j])) for j in range(3)], 1)
    plain = np.einsum

    def two(spec, *a, **k):
        assert len(a) <= 2, "an outer product of every row and component"
        return plain(spec, *a, **k)

    monkeypatch.setattr(np, "einsum", two)
    assert np.allclose(mixture.sums(x, r, np.full(500, 7.0)), want, rtol=1e-12)
    assert np.allclose(np.exp(mixture.log_joint(x, w, m, c)), dens, rtol=1e-9)


# --- KNN imputation ---

def naive_impute(x, k):
    out = x.copy()
    d = x.shape[1]
    for i in range(len(x)):
        for j in np.flatnonzero(np.isnan(x[i])):
            found = []
            for o in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[o])
                if o != i and not np.isnan(x[o, j]) and both.any():
                    found.append((((x[i, both] - x[o, both]) ** 2).sum() * d / both.sum(), o))
            near = [x[o, j] for _, o in sorted(found)[:k]]
            out[i, j] = np.mean(near) if near else np.nanmean(x[:, j]) if (~np.isnan(x[:, j])).any() else np.nan
    return out


@pytest.mark.parametrize("cell_rows,block", [(1000, 4096), (5, 16)])
def test_knn_imputation_equals_brute_force(spark, cell_rows, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(240, 4)).round(1) * [1, 10, 1, 3]
    x[rng.random(x.shape) < 0.15] = np.nan
    x[5] = np.nan  # shares no column with any row
    x[50:90] = x[50]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], None, "t") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, cell string")
    got = neighbours.knn_impute(df, ["a", "b", "c", "d", "e"], k=3, key="id", cell_rows=cell_rows, block=block)
    assert got.columns == df.columns
    want = naive_impute(np.column_stack([x, np.full(len(x), np.nan)]), 3)
    for r in got.collect():
        assert np.allclose([r.a, r.b, r.c, r.d], want[r.id, :4], atol=1e-9) and r.e is None
    assert neighbours.knn_impute(df.limit(0), ["a", "b"], key="id").count() == 0


def test_knn_donors_that_agree_are_cut_to_k_and_equal_rows_ask_once(spark):
    nan = np.nan
    v = np.array([[1, nan], [2, 3], [1, nan], [1, nan], [2, 3], [0, 3]], float)
    assert neighbours._first_of_equal(v, 2).tolist() == [0, 1, 2, 4, 5]
    d2 = np.array([[4.0, 1, 1, 1, 0], [np.inf, np.inf, 2, 5, np.inf]])
    assert np.stack(neighbours._smallest(d2, 3), 1).tolist() == [[0, 1], [0, 2], [0, 4], [1, 2], [1, 3]]
    rng = np.random.default_rng(3)  # few values: most donors tie
    x = np.column_stack([rng.integers(0, 3, 400), rng.integers(0, 2, 400), rng.normal(size=400)]).astype(float)
    x[rng.random(x.shape) < 0.2] = nan
    df = spark.createDataFrame([(i, *[None if np.isnan(c) else float(c) for c in r]) for i, r in enumerate(x)],
                               "id long, a double, b double, c double")
    want = naive_impute(x, 5)
    for r in neighbours.knn_impute(df, ["a", "b", "c"], key="id", cell_rows=20, block=32).collect():
        assert np.allclose([r.a, r.b, r.c], want[r.id], atol=1e-9)


# --- fitting and Tukey ---

def test_fitting_recovers_parameters(spark):
    rng = np.random.default_rng(9)
    n = 20_000
    data = zip(rng.gamma(2.5, 3.0, n), rng.weibull(1.7, n) * 4, rng.lognormal(1.0, 0.5, n), rng.normal(-3, 2, n), rng.exponential(5, n))
    df = spark.createDataFrame([tuple(map(float, r)) for r in data], "g double, w double, l double, m double, e double")
    got = {(r.column_name, r.family): r for r in fitting.fit_distributions(df.withColumn("k", F.lit(1.0))).collect()}
    assert {f for c, f in got if c == "m"} == {"normal"} and not [c for c, _ in got if c == "k"]
    for c, f, a, b in (("g", "gamma", 2.5, 3.0), ("w", "weibull", 1.7, 4.0), ("l", "lognormal", 1.0, 0.5), ("m", "normal", -3, 2)):
        r = got[c, f]
        assert abs(r.parameter1 - a) < 0.06 * abs(a) and abs(r.parameter2 - b) < 0.06 * b
        assert r.ks < 0.015 and r["rank"] == 1
    assert abs(got["e", "exponential"].parameter1 - 0.2) < 0.01
    # the likelihood is the sum of log densities, and greatest at the parameters found
    x = np.array([r.w for r in df.select("w").collect()])
    def ll(k, s):
        return (math.log(k / s) + (k - 1) * np.log(x / s) - (x / s) ** k).sum()
    r = got["w", "weibull"]
    assert abs(ll(r.parameter1, r.parameter2) - r.log_likelihood) < 1e-6 * abs(r.log_likelihood)
    assert ll(r.parameter1 * 1.01, r.parameter2) < r.log_likelihood > ll(r.parameter1, r.parameter2 * 0.99)


def test_studentised_range_equals_published_table():
    for p, k, df, want in ((.05, 3, 10, 3.877), (.05, 5, 20, 4.232), (.01, 4, 15, 5.252), (.05, 10, 60, 4.646), (.05, 2, 5, 3.635)):
        assert abs(tukey.studentised_range_quantile(p, k, df) - want) < 1e-3


def test_tukey_pairs(spark):
    rng = np.random.default_rng(10)
    rows = [(g, float(rng.normal(m, 1))) for g, m, n in (("a", 0, 30), ("b", 0.1, 20), ("c", 3, 25)) for _ in range(n)] + [(None, 1.0), ("a", None)]
    got = {(r.group1, r.group2): r for r in tukey.tukey_pairs(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert not got["a", "b"].significant and got["a", "c"].significant and got["b", "c"].significant
    assert got["a", "c"].low < got["a", "c"].difference < got["a", "c"].high and got["a", "c"].df_within == 72
    assert got["a", "b"].low < 0 < got["a", "b"].high


# --- PACF and forecasts ---

def naive_pacf(x, lags):
    x = x - x.mean()
    r = np.array([(x[:len(x) - k] * x[k:]).sum() for k in range(lags + 1)]) / (x * x).sum()
    return [np.linalg.solve(np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)]), r[1:k + 1])[-1] for k in range(1, lags + 1)]


def series_frame(spark, series):
    rows = [(name, i, float(v)) for name, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "series string, bucket long, v double").repartition(7)


def test_pacf_equals_yule_walker(spark):
    rng = np.random.default_rng(11)
    x = np.zeros(120)
    for t in range(2, 120):
        x[t] = 0.6 * x[t - 1] - 0.3 * x[t - 2] + rng.normal()
    got = forecast.ts_pacf(series_frame(spark, {"x": x, "flat": np.ones(60), "short": x[:5]}), 20).orderBy("lag").collect()
    assert {r.series for r in got} == {"x"} and [r.lag for r in got] == list(range(1, 21))
    assert np.allclose([r.pacf for r in got], naive_pacf(x, 20), atol=1e-9)
    assert got[0].significant and got[1].significant


def loop(x, period, a, b, g):
    state = forecast.start_state(x[:2 * (period or 1)], period)
    level, trend, season = state[0], state[1], list(state[2:])
    sse = 0.0
    for y in x:
        s = season[0] if period else 0.0
        e = y - (level + trend + s)
        sse += e * e
        level, trend = level + trend + a * e, trend + a * b * e
        if period:
            season = [*season[1:], s + g * (1 - a) * e]
    return sse, [level + h * trend + (season[(h - 1) % period] if period else 0.0) for h in range(1, 13)]


@pytest.mark.parametrize("period", [None, 4])
def test_forecast_equals_a_loop(spark, period):
    rng = np.random.default_rng(12)
    t = np.arange(90)
    series = {"a": 3 + 0.5 * t + 4 * np.sin(t * math.pi / 2) + rng.normal(size=90), "b": rng.normal(size=31).cumsum(), "c": np.ones(1)}
    got = forecast.forecast(series_frame(spark, series), period=period, per_range=11).collect()
    held = forecast.candidates(period)
    for name in "ab":
        best = min((loop(series[name], period, *p) for p in held), key=lambda r: r[0])
        mine = sorted((r.step, r.forecast, r.sse) for r in got if r.series == name)
        assert [m[0] for m in mine] == list(range(1, 13))
        assert np.allclose([m[1] for m in mine], best[1], atol=1e-7) and abs(mine[0][2] - best[0]) < 1e-6
    assert not [r for r in got if r.series == "c"]


def test_forecast_of_a_line_goes_on(spark):
    got = forecast.forecast(series_frame(spark, {"x": 2.0 + 3.0 * np.arange(40)})).orderBy("step").collect()
    assert np.allclose([r.forecast for r in got], 2 + 3.0 * np.arange(40, 52), atol=1e-9)
    empty = spark.createDataFrame([], "series string, bucket long, v double")
    assert forecast.forecast(empty).count() == 0


# --- ADF, gates, sketch, CSV and the whole run ---

def test_adf_along_ranges_equals_the_whole_series(spark):
    from statloom.operators import timeseries as TS
    from statloom.operators.stationarity import adf
    rng = np.random.default_rng(13)
    series = {"noise": rng.normal(size=150), "walk": rng.normal(size=90).cumsum(), "short": np.arange(9.0), "flat": np.ones(40),
              "line": 5 + 2.0 * np.arange(50), "ar": np.convolve(rng.normal(size=230), [1, 0.7, 0.2])[:200] * 1e6 + 1e9}
    for per_range in (10 ** 6, 17):
        got = {r.series: r for r in adf(series_frame(spark, series), per_range).collect()}
        assert set(got) == {"noise", "walk", "line", "ar"}
        assert got["line"].adf_stat is None and got["line"].stationary is None
        for name in ("noise", "walk", "ar"):
            want = TS.adf_test(series[name])
            assert got[name].used_lag == want["used_lag"] and got[name].nobs == want["nobs"]
            assert abs(got[name].adf_stat - want["adf_stat"]) < 1e-6 and abs(got[name].p_value - want["p_value"]) < 1e-6
            assert abs(got[name].crit_5 - want["crit_5"]) < 1e-9


def test_automatic_period(spark):
    from statloom.operators import timeseries as TS
    s = series_frame(spark, {"a": np.sin(np.arange(40.0)) + np.arange(40), "b": np.arange(6.0) ** 2})
    assert TS.auto_periods(s, 400) == {7: None} and TS.auto_periods(s, 60) == {4: None}
    assert {k: sorted(v) for k, v in TS.auto_periods(s, 40).items()} == {12: ["a"], 3: ["b"]}
    assert [(r.series, r.period) for r in TS.ts_strength_auto(s, 40).collect()] == [("a", 12)]


def test_frequent_directions_bound(spark):
    from statloom.operators import sketch
    rng = np.random.default_rng(14)
    x = rng.normal(size=(900, 12)) @ np.diag(np.linspace(0.2, 4, 12))
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(12))).repartition(9)
    b = sketch.frequent_directions(df, df.columns, size=16, fan_in=2)
    assert len(b) <= 16
    assert np.linalg.norm(x.T @ x - b.T @ b, 2) <= (x * x).sum() / 8 * (1 + 1e-9)
    assert np.linalg.eigvalsh(x.T @ x - b.T @ b).min() > -1e-6  # never above the table
    whole = {r.component: r.explained_ratio for r in sketch.incremental_pca(df).collect()}
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.eigvalsh(z.T @ z)[::-1] / (z * z).sum()
    assert all(want[j - 1] - 2 / sketch.SIZE - 1e-9 <= r <= want[j - 1] + 1e-9 for j, r in whole.items())
    assert sketch.incremental_pca(df.limit(0)).count() == 0


def test_csv_is_split_unless_a_field_holds_a_newline(spark, tmp_path):
    from statloom.sources import io as S
    plain, odd = tmp_path / "a.csv", tmp_path / "b.csv"
    plain.write_text('k,v\n1,"x ""y"""\n2,z\n')
    odd.write_text('k,v\n1,"x\ny"\n2,z\n')
    assert not S.has_quoted_newlines(spark, str(plain)) and S.has_quoted_newlines(spark, str(odd))
    assert [r.v for r in S.read_csv(spark, str(plain)).orderBy("k").collect()] == ['x "y"', "z"]
    assert [r.v for r in S.read_csv(spark, str(odd)).orderBy("k").collect()] == ["x\ny", "z"]


def test_full_analysis_keeps_going_and_fails_on_lost_jobs(spark):
    from statloom.operators.prepare import AnalysisParams
    from statloom.plans import engine
    rng = random.Random(15)
    rows = [(i, round(rng.gauss(0, 1), 1), round(rng.gauss(5, 2) + i / 50), rng.choice("abc"), None if i % 9 == 0 else i % 40)
            for i in range(300)]  # few values each: near-unique columns are screened out
    rows = [(i, x, float(y + round(2 * x)), k, q) for i, x, y, k, q in rows]
    df = spark.createDataFrame(rows, "id long, x double, revenue double, kind string, q long")
    params = AnalysisParams(analysis_types=("descriptive", "correlations", "outliers"), advanced_analysis=("pca", "famd"))
    out = engine.full_analysis(df, params, key="id")
    assert {"categories", "processed", "descriptive_numeric", "pearson", "outliers_iqr", "famd_inertia", "findings", "report"} <= set(out)
    assert out["processed"].where("q IS NULL").count() == 0
    assert out["report"].where("section = 'analyses'").count() > 5
    broken = df.withColumn("x", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        engine.analyze(broken, params, key="id")["pca_summary"].collect()


def test_kendall_cuts_a_hot_value(spark):
    from statloom.operators.kendall import corr_kendall
    rng = np.random.default_rng(16)
    x, y = rng.integers(0, 20, 300), rng.integers(0, 200, 300)
    x[:120], y[100:200] = 7, 50
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(300) for j in range(i))
    n0, tx, ty = 300 * 299 / 2, sum(c * (c - 1) / 2 for c in np.unique(x, return_counts=True)[1]), sum(
        c * (c - 1) / 2 for c in np.unique(y, return_counts=True)[1])
    for per_block in (10 ** 6, 20):
        assert abs(corr_kendall(df, ["x", "y"], per_block).first().tau - s / math.sqrt((n0 - tx) * (n0 - ty))) < 1e-12


def test_ranks_come_back_by_broadcast_and_by_shuffle_alike(spark, monkeypatch):
    from statloom.operators import correlate
    rng = np.random.default_rng(17)
    rows = [(i, float(rng.integers(0, 4)), float(rng.normal()) if i % 7 else None, 0.0 if i % 3 else float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    frames = {}
    for cells in (100_000, 10, 0):
        monkeypatch.setattr(correlate, "BROADCAST_CELLS", cells)
        frames[cells] = sorted(tuple(r[k] for k in ("id", "a", "b", "c")) for r in correlate.with_ranks(df, ["a", "b", "c"]).collect())
        rho = {(r.var1, r.var2): r.r for r in correlate.corr_spearman(df, ["a", "c"]).collect()}
    assert frames[100_000] == frames[10] == frames[0]
    import pandas as pd
    want = pd.DataFrame(rows, columns=["id", "a", "b", "c"])
    assert np.allclose([r[1] for r in frames[0]], want["a"].rank()) and np.allclose([r[3] for r in frames[0]], want["c"].rank())
    assert abs(rho["a", "c"] - want[["a", "c"]].corr("spearman").iloc[0, 1]) < 1e-9


def test_near_unique_screen_counts_exactly_near_the_threshold(spark):
    from statloom.operators.correlate import near_unique
    df = spark.range(2_000).select(F.col("id").alias("u"), (F.col("id") % 1_899).alias("v"), (F.col("id") % 1_902).alias("w"),
                                   (F.col("id") % 5).alias("k"))
    assert near_unique(df, ["u", "v", "w", "k"], 0.95) == ["u", "w"]
    assert near_unique(df.limit(0), ["u"], 0.95) == []


def test_partial_correlation_equals_regression_residuals(spark):
    from statloom.operators.correlate import corr_partial
    rng = np.random.default_rng(18)
    x = rng.normal(size=(200, 4))
    x[:, 1] += x[:, 0]
    x[:, 2] -= 0.5 * x[:, 1] + x[:, 3]
    df = spark.createDataFrame(x.tolist() + [[1.0, None, 1.0, 1.0]], "a double, b double, c double, d double")
    got = {(r.var1, r.var2): r for r in corr_partial(df).collect()}
    for i, j in itertools.combinations(range(4), 2):
        rest = np.column_stack([np.ones(200), *[x[:, k] for k in range(4) if k not in (i, j)]])
        u, v = (x[:, k] - rest @ np.linalg.lstsq(rest, x[:, k], rcond=None)[0] for k in (i, j))
        r = got["abcd"[i], "abcd"[j]]
        assert r.n == 200 and abs(r.r_partial - np.corrcoef(u, v)[0, 1]) < 1e-9
    both = df.withColumn("e", F.col("a") * 2)
    assert all(r.r_partial is None for r in corr_partial(both).collect())
    assert corr_partial(df.limit(0)).first().r_partial is None


def test_trend_curves_equal_polyfit(spark):
    from statloom.operators import timeseries as TS
    rng = np.random.default_rng(19)
    t = np.arange(40.0)
    series = {"q": 3 - t + 0.2 * t ** 2 + rng.normal(size=40), "e": np.exp(0.1 * t + 1), "flat": np.full(12, 2.0), "short": t[:5]}
    got = {(r.series, r.method): r for r in TS.ts_trend_curves(series_frame(spark, series)).collect()}
    c, b, a = np.polyfit(t, series["q"], 2)
    r = got["q", "polynomial"]
    assert np.allclose([r.intercept, r.slope, r.curvature], [a, b, c]) and 0.9 < r.r2 <= 1
    assert abs(got["e", "exponential"].slope - 0.1) < 1e-9 and abs(got["e", "exponential"].intercept - 1) < 1e-9
    assert got["flat", "linear"].r2 == 0 and ("short", "linear") not in got
    assert ("q", "exponential") not in got or series["q"].min() > 0


def test_kmeans_shares_scans_and_equals_numpy(spark):
    from statloom.operators import multivariate as M
    rng = np.random.default_rng(20)
    x = np.concatenate([rng.normal(c, 0.6, (50, 3)) for c in (0, 4, 9)] + [np.full((3, 3), 30.0)])
    df = spark.createDataFrame(x.tolist() + [[None, 1.0, 1.0]], "a double, b double, c double").repartition(4)
    z = np.array(mixture.scaled(df, ["a", "b", "c"]).collect())
    models = [(k, r) for k in (2, 4) for r in range(3)]
    fitted = M.lloyd(mixture.scaled(df, ["a", "b", "c"]), ["a", "b", "c"], models, len(z))
    for k, r in models:
        inertia, rows, _, sums, centres = fitted[k, r]
        home = ((z[:, None] - centres) ** 2).sum(2).argmin(1)
        assert rows.tolist() == np.bincount(home, minlength=len(centres)).tolist()
        assert abs(inertia - ((z - centres[home]) ** 2).sum()) < 1e-9
        for c in np.unique(home):  # Lloyd has come to rest
            assert np.allclose(centres[c], z[home == c].mean(0), atol=1e-3)
    sweep = {r.k: r for r in M.kmeans_sweep(df, ["a", "b", "c"], k_range=(2, 3, 4), restarts=4).collect()}
    best = {k: fitted[min(((k, r) for r in range(3)), key=lambda m: fitted[m][0])] for k in (2, 4)}
    d2 = ((z[:, None] - z[None]) ** 2).sum(2)
    home = ((z[:, None] - best[4][4]) ** 2).sum(2).argmin(1)
    s = []
    for i in range(len(z)):
        mean = {c: d2[i, home == c].sum() / max(1, (home == c).sum() - (c == home[i])) for c in np.unique(home)}
        a, b = mean.pop(home[i]), min(mean.values())
        s.append(0.0 if (home == home[i]).sum() == 1 else (b - a) / max(a, b))
    assert abs(M._silhouettes(z, best[4]) - sum(s)) < 1e-6
    assert sweep[2].inertia > sweep[3].inertia > sweep[4].inertia and sum(r.is_best for r in sweep.values()) == 1
    assert M.kmeans_sweep(df.limit(0), ["a", "b", "c"]).count() == 0 == M.kmeans_profile(df.limit(0), 3, ["a", "b", "c"]).count()
