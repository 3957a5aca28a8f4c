"""Core primitives: rounding parity, ranks, quantiles, moments, special functions."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.functions import ranks, special
from statloom.functions.exprs import sig_columns, sig_sql
from statloom.operators.describe import moments


def test_sig_parity_with_duckdb(spark, duck):
    vals = [0.1, 1e-5, 3.33333333e-05, 249.845, -7.86520135e-05, 123456789.123, 5e-15, 0.0, 1e300, 2.0 / 3]
    sdf = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r.x for r in sig_columns(sdf, ["x"]).orderBy("i").collect()]
    rows = duck.execute("SELECT i, " + sig_sql("x") + " FROM (VALUES " +
                        ", ".join(f"({i}, {v!r}::DOUBLE)" for i, v in enumerate(vals)) + ") t(i, x) ORDER BY i").fetchall()
    assert got == [r[1] for r in rows]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=60))
def test_average_ranks_match_pandas(spark, xs):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "id long, value double")
    cells = ranks.ranked_cells(df.withColumn("column_name", F.lit("x")), ["column_name"]).collect()
    got = {r.value: r.avg_rank for r in cells}
    exp = pd.Series(xs, dtype=float).rank(method="average")
    for x, r in zip(xs, exp):
        assert got[float(x)] == r


@pytest.mark.parametrize("bound", [10**9, 5])
def test_quantiles_match_numpy_both_paths(spark, bound, monkeypatch):
    monkeypatch.setattr(ranks, "WINDOW_CELL_BOUND", bound)
    rng = np.random.default_rng(1)
    a = np.round(rng.exponential(3, 500), 1)
    df = spark.createDataFrame([(float(v),) for v in a], "a double").repartition(7)
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    q = {r.prob: r.q for r in ranks.exact_quantiles(df, ["a"], probs).collect()}
    for p in probs:
        assert math.isclose(q[p], np.quantile(a, p), rel_tol=1e-12, abs_tol=1e-12)


def test_cumulate_range_path_gives_same_ranks(spark):
    df = spark.range(0, 300).select((F.col("id") % 37).cast("double").alias("value"),
                                    F.lit("c").alias("column_name"))
    cells = ranks.value_cells(df, ["column_name"])
    a = {r.value: r.cum_before for r in ranks.cumulate(cells, ["column_name"], window_bound=10**9).collect()}
    b = {r.value: r.cum_before for r in ranks.cumulate(cells, ["column_name"], window_bound=3).collect()}
    assert a == b


def test_global_row_number_is_dense(spark):
    df = spark.range(0, 1000).repartition(5)
    r = ranks.global_row_number(df, ["id"]).collect()
    assert sorted(x.row_number for x in r) == list(range(1, 1001))
    assert all(x.row_number == x.id + 1 for x in r)


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(2)
    a = rng.gamma(2.0, 3.0, 400) + 1e6  # large offset: two-pass must stay exact
    df = spark.createDataFrame([(float(v),) for v in a], "a double")
    m = moments(df, ["a"]).first()
    s = pd.Series(a)
    assert math.isclose(m.mean, s.mean(), rel_tol=1e-12)
    assert math.isclose(m.var, s.var(), rel_tol=1e-9)
    assert math.isclose(m.skew, s.skew(), rel_tol=1e-7)
    assert math.isclose(m.kurt, s.kurt(), rel_tol=1e-7)


def test_moments_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0)], "x double, c double")
    r = {x.column_name: x for x in moments(df, ["x", "c"]).collect()}
    assert r["x"]["count"] == 1 and r["x"].std is None and r["x"].skew is None
    assert r["c"].std == 0.0
    empty = spark.createDataFrame([], "x double")
    e = moments(empty, ["x"]).first()
    assert e["count"] == 0 and e.mean is None


def test_special_functions_against_tables():
    # two-sided t critical values: t(0.975, 10) = 2.228139, t(0.975, 1) = 12.7062
    assert math.isclose(special.t_sf_two_sided(2.228139, 10)[()], 0.05, abs_tol=1e-6)
    assert math.isclose(special.t_sf_two_sided(12.7062047, 1)[()], 0.05, abs_tol=1e-6)
    # F(0.95; 3, 20) = 3.098391
    assert math.isclose(special.f_sf(3.098391, 3, 20)[()], 0.05, abs_tol=1e-6)
    # chi-square(0.95; 2) = 5.991465, (0.95; 10) = 18.307038
    assert math.isclose(special.chi2_sf(5.991465, 2)[()], 0.05, abs_tol=1e-6)
    assert math.isclose(special.chi2_sf(18.307038, 10)[()], 0.05, abs_tol=1e-6)
    assert math.isclose(special.norm_sf(1.959964)[()], 0.025, abs_tol=1e-7)


def test_values_inside_brackets_are_counted_by_batch(spark):
    """Values at the ends, ties, both zeros, infinities and nulls; rows are not blown up before they are counted."""
    from statloom.functions.select import _values_inside
    inf = float("inf")
    vals = [None, -inf, -3.0, -0.0, 0.0, 1.0, 1.0, 2.0, 2.5, 7.0, 7.0, 7.0, 9.0, inf]
    df = spark.createDataFrame([(v, None if v is None else -v) for v in vals], "a double, b double").repartition(3)
    brackets = {0: [(0.0, 1.0), (1.0, 2.0), (7.0, 7.0)], 1: [(None, -9.0), (2.0, None)]}
    out = _values_inside(df, ["a", "b"], brackets)
    assert "Generate" not in out._jdf.queryExecution().toString()
    got = {(r.ci, r.value): r.cnt for r in out.collect()}
    assert got == {(0, 0.0): 2, (0, 1.0): 2, (0, 2.0): 1, (0, 7.0): 3, (1, -inf): 1, (1, -9.0): 1, (1, 3.0): 1, (1, inf): 1}


@pytest.mark.parametrize("acc,limit", [(10000, 50000), (50, 20)])
def test_selection_quantiles_exact(spark, acc, limit):
    from statloom.functions.select import exact_quantiles_select
    rng = np.random.default_rng(7)
    a = np.round(rng.exponential(3, 3000), 1)
    c = np.where(rng.random(3000) < 0.4, 0.0, rng.normal(size=3000))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, c)], "a double, c double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    q = {(r.column_name, r.prob): r.q for r in exact_quantiles_select(df, ["a", "c"], probs, acc, limit).collect()}
    for name, v in [("a", a), ("c", c)]:
        for p in probs:
            assert math.isclose(q[(name, p)], np.quantile(v, p), rel_tol=1e-12, abs_tol=1e-12)


def test_global_row_number_range_path(spark, monkeypatch):
    monkeypatch.setattr(ranks, "WINDOW_CELL_BOUND", 10)
    monkeypatch.setattr(ranks, "CELLS_PER_RANGE_PARTITION", 50)
    df = spark.range(0, 400).select((F.col("id") * 7 % 400).alias("k")).repartition(3)
    r = ranks.global_row_number(df, ["k"]).collect()
    assert sorted((x.k, x.row_number) for x in r) == [(i, i + 1) for i in range(400)]


def test_cumulate_range_path_many_groups(spark):
    df = spark.range(0, 600).select((F.col("id") % 3).cast("string").alias("g"),
                                    ((F.col("id") * 13) % 50).cast("double").alias("value"))
    cells = ranks.value_cells(df, ["g"])
    win = {(r.g, r.value): (r.cum_before, r.n) for r in ranks.cumulate(cells, ["g"], window_bound=10**9).collect()}
    rng_ = {(r.g, r.value): (r.cum_before, r.n) for r in ranks.cumulate(cells, ["g"], window_bound=4).collect()}
    assert win == rng_
    pdf = df.toPandas()
    for (g, v), (cb, n) in win.items():
        sub = pdf[pdf.g == g].value
        assert cb == (sub < v).sum() and n == len(sub)


def test_selection_with_nulls_nan_and_empty_column(spark):
    from statloom.functions.select import exact_quantiles_select
    rows = [(float(i) if i % 5 else None, float("nan") if i % 7 == 0 else float(i % 13), None) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, e double")
    q = {(r.column_name, r.prob): r.q for r in exact_quantiles_select(df, ["a", "b", "e"], [0.1, 0.5, 0.9], 50, 20).collect()}
    a = np.array([r[0] for r in rows if r[0] is not None])
    b = np.array([r[1] for r in rows if not math.isnan(r[1])])
    for p in (0.1, 0.5, 0.9):
        assert math.isclose(q[("a", p)], np.quantile(a, p))
        assert math.isclose(q[("b", p)], np.quantile(b, p))
        assert q[("e", p)] is None


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 4)), min_size=0, max_size=40))
def test_dominance_weighted_brute_force(pts):
    from statloom.operators.kendall import dominance_weighted
    g = np.array([p[0] for p in pts], dtype=np.int64)
    r = np.array([p[1] for p in pts], dtype=np.int64)
    c = np.array([p[2] for p in pts], dtype=np.int64)
    exp = sum(ci * cj for (gi, ri, ci) in pts for (gj, rj, cj) in pts if gi < gj and ri < rj)
    assert dominance_weighted(g, r, c) == exp
