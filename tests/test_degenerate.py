"""Input off the beaten track: range-partitioned ranks, constants, NaN, odd dates, quoted CSV, explicit lists."""

import math

import numpy as np
import pytest

from statloom.functions import ranks
from statloom.operators import charts, correlate, hypothesis, outliers, prepare, profile, timeseries
from statloom.operators.dbscan import dbscan_labels
from statloom.operators.prepare import AnalysisParams
from statloom.plans.engine import analyze
from statloom.sources import io


@pytest.fixture
def small_bound(monkeypatch):
    monkeypatch.setattr(ranks, "WINDOW_CELL_BOUND", 1_000)
    monkeypatch.setattr(ranks, "CELLS_PER_RANGE_PARTITION", 2_000)


@pytest.fixture(scope="module")
def odd(spark):
    nan = float("nan")
    rows = [(i, 5.0, float(i % 7) if i % 3 else nan, float(i) if i % 2 else None, None if i % 2 else float(i), i * 0.1,
             ("a", "b", None)[i % 3]) for i in range(60)]
    return spark.createDataFrame(rows, "key long, flat double, gaps double, odd double, even double, total_amount double, cat string")


def test_range_path_numbers_every_row_once(spark, small_bound):
    df = spark.range(30_000).selectExpr("(id * 7919) % 30000 AS k", "id % 11 AS payload", "cast(id AS string) AS more")
    got = ranks.global_row_number(df.repartition(7), ["k"]).select("k", "row_number").toPandas()
    assert (got["row_number"] == got["k"] + 1).all() and len(got) == 30_000
    sizes = {r["count"] for r in io.chunk_ids(df.repartition(5), ["k"], 1_000).groupBy("chunk_id").count().collect()}
    assert sizes == {1_000}


def test_mann_whitney_is_the_same_on_both_paths(spark, monkeypatch):
    df = spark.range(8_000).selectExpr("cast((id * 37) % 4001 AS double) AS x", "cast((id * 91) % 3907 AS double) / 2 AS y")
    want = hypothesis.mann_whitney(df, ["x", "y"]).first()["statistic"]
    monkeypatch.setattr(ranks, "WINDOW_CELL_BOUND", 500)
    monkeypatch.setattr(ranks, "CELLS_PER_RANGE_PARTITION", 400)
    assert [hypothesis.mann_whitney(df, ["x", "y"]).first()["statistic"] for _ in range(2)] == [want, want]


def test_undefined_correlations_are_null(odd):
    cols = ["flat", "gaps", "odd", "even", "total_amount"]
    for f in (correlate.corr_pearson, correlate.corr_spearman):
        got = {(r.var1, r.var2): (r.n, r.r) for r in f(odd, cols).collect()}
        assert all(r is None for (a, b), (n, r) in got.items() if "flat" in (a, b))
        assert got["odd", "even"] == (0, None)
        assert abs(got["odd", "total_amount"][1] - 1) < 1e-9
    assert {(r.target, r.feature) for r in correlate.corr_target(odd, cols, screen=False).collect()} == {
        ("total_amount", "odd"), ("total_amount", "even")}
    assert correlate.corr_significant(odd, cols, screen=False).count() == 0


def test_constant_columns_do_not_stop_the_tests(spark, odd):
    cols = ["flat", "total_amount"]
    flat = {r.column_name: r.statistic for r in hypothesis.normality_anderson(odd, cols).collect()}
    assert flat["flat"] is None and flat["total_amount"] is not None
    assert {r.column_name: r.statistic for r in hypothesis.normality_ks(odd, cols).collect()}["flat"] is None
    both = odd.selectExpr("5.0D AS a", "5.0D AS b")
    assert hypothesis.t_test_pairs(both).first()["statistic"] is None
    assert hypothesis.mann_whitney(both).first()["z"] is None
    assert hypothesis.anova_oneway(odd, ["cat"], ["flat"]).first()["statistic"] is None
    assert hypothesis.kruskal_wallis(odd, "cat", "flat").first()["statistic"] is None
    assert {r.feature: r.abs_r for r in hypothesis.importance_correlation(odd, cols).collect()} == {"flat": None}
    assert outliers.outliers_zscore(odd, "key", cols).count() == 2
    series = spark.range(40).selectExpr("'s' AS series", "timestamp_seconds(id * 86400) AS bucket", "3.0D AS v")
    assert timeseries.ts_acf(series).filter("acf IS NOT NULL").count() == 0
    trend = timeseries.ts_trend(series).first()
    assert (trend["r2"], trend["direction"]) == (0.0, "flat")
    assert {r.share for r in charts.chart_pie(odd.selectExpr("cat", "0.0D AS v"), "cat", "v").collect()} == {None}


def test_nan_is_missing(odd):
    prof = {r.column_name: r for r in profile.unique_ratio(odd).collect()}
    assert prof["gaps"].n_distinct == 7
    filled = prepare.impute_median(odd, ["gaps"])
    assert filled.filter("gaps IS NULL OR isnan(gaps)").count() == 0
    mostly = odd.selectExpr("CASE WHEN key < 50 THEN double('NaN') ELSE 1.0D + key END AS m")
    assert ("high_missing", "m") in {(r.rule, r.column_name) for r in profile.validate_table(mostly).collect()}
    assert prepare.drop_sparse_columns(odd.selectExpr("key", "double('NaN') AS gone")).columns == ["key"]


def test_binary_labels_of_booleans_and_integers_with_nulls(spark):
    df = spark.createDataFrame([(True, 3), (False, 10), (None, None), (True, 3)], "b boolean, i int")
    got = prepare.label_encode_binary(prepare.label_encode_binary(df, "b"), "i").collect()
    assert len({r.b_encoded for r in got}) == 3 and len({r.i_encoded for r in got}) == 3


def test_slash_dates_keep_one_format_per_column(spark):
    df = spark.createDataFrame([("01/02/2024", "25/03/2024"), ("03/25/2024", "01/02/2024"), ("12/31/2024", None)], "m string, d string")
    got = prepare.parse_datetime(df, ["m", "d"]).collect()
    assert [r.m.strftime("%m-%d") for r in got] == ["01-02", "03-25", "12-31"]
    assert [r.d and r.d.strftime("%m-%d") for r in got] == ["03-25", "02-01", None]


def test_csv_keeps_quotes_and_newlines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'He said "hi", ok'), (2, "two\nlines"), (3, "plain")], "id int, t string")
    path = io.write_csv(df.coalesce(1), str(tmp_path / "out"))
    assert {(r.id, r.t) for r in io.read_csv(spark, path).collect()} == {(1, 'He said "hi", ok'), (2, "two\nlines"), (3, "plain")}


def test_explicit_lists_are_used_whole(spark):
    df = spark.range(80).selectExpr("id % 3 AS g", "cast(id % 2 AS string) AS c1", *[f"cast(id * {k} % 17 AS double) AS n{k}" for k in range(1, 7)])
    nums = [f"n{k}" for k in range(1, 7)]
    assert hypothesis.t_test_pairs(df, nums).count() == 15
    assert hypothesis.anova_oneway(df, ["c1"], nums).count() == 6


def test_shapiro_by_cells_equals_the_sorted_form(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.gamma(2.0, size=300), 2)
    df = spark.createDataFrame([(float(v), 1.5, float(i) if i < 10 else None) for i, v in enumerate(x)], "x double, flat double, few double")
    got = {r.column_name: r for r in hypothesis.normality_shapiro(df, ["x", "flat", "few"], status=True).collect()}
    w, p = hypothesis.shapiro_wilk(x)
    assert math.isclose(got["x"].statistic, w, rel_tol=1e-9) and math.isclose(got["x"].p_value, p, rel_tol=1e-6)
    assert (got["flat"].statistic, got["flat"].status, got["few"].status) == (1.0, "ok", "too_few_values")


def test_dbscan_follows_a_long_chain(spark):
    df = spark.range(3_000).selectExpr("cast(id AS double) * 0.01 AS x", "cast(id % 2 AS double) * 0.001 AS y")
    lab = dbscan_labels(df, ["x", "y"], eps=0.5, min_samples=2)
    assert lab.filter("label <> -1").select("label").distinct().count() <= 2


def test_analyze_passes_on_odd_input(spark, odd):
    kinds = ("descriptive", "correlations", "distributions", "outliers", "hypothesis_tests")
    got = analyze(odd, AnalysisParams(analysis_types=kinds, advanced_analysis=("regression",)), key="key")
    for name, df in got.items():
        df.collect()
    assert "kendall" in got or "kendall_status" in got


def test_kendall_counts_pass_64_bits(spark):
    from statloom.operators.kendall import dominance_count
    big = 5_000_000_000
    cells = spark.createDataFrame([(float(i), float(i), big) for i in range(6)], "x double, y double, c long")
    for per_block in (100, 2):
        assert dominance_count(cells, per_block) == 15 * big * big
