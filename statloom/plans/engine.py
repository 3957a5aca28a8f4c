"""``analyze``: the reference's analysis run as a dictionary of lazy DataFrames.

Analysis labels follow the reference's options (English names); each block
is gated the same way (numeric column counts, presence of a time column).
Small profiling actions decide which columns exist; everything else stays
lazy until the caller writes or collects a frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from statloom.functions.exprs import numeric_columns, string_columns, time_columns
from statloom.operators import correlate as R
from statloom.operators import describe as D
from statloom.operators import hypothesis as H
from statloom.operators import multivariate as M
from statloom.operators import outliers as O
from statloom.operators import timeseries as TS
from statloom.operators import profile as P
from statloom.operators import text as X
from statloom.operators.dbscan import dbscan_summary
from statloom.operators.forecast import forecast, ts_pacf
from statloom.operators.iforest import outliers_isolation_forest
from statloom.operators.kendall import corr_kendall
from statloom.operators.prepare import AnalysisParams, preprocess
from statloom.session import ensure_checkpoint_dir, ensure_parallelism

DEFAULT_ANALYSES = ("descriptive", "correlations")
ALL_ANALYSES = ("descriptive", "correlations", "distributions", "outliers", "time_series",
                "hypothesis_tests")
ADVANCED = ("pca", "famd", "clustering", "regression")


def analyze(df: DataFrame, params: AnalysisParams | None = None, key: str | None = None
            ) -> dict[str, DataFrame]:
    params = params or AnalysisParams()
    kinds = set(params.analysis_types)
    adv = set(params.advanced_analysis)
    nums = [c for c in numeric_columns(df) if c != key]
    cats = string_columns(df)
    out: dict[str, DataFrame] = {}

    def block(name: str, make) -> None:
        """A block that cannot run on this table gives a one-row status frame instead of ending the analysis."""
        try:
            got = make()
        except ValueError as e:  # an operator's own refusal; a failed job goes on up
            got = {f"{name}_status": df.sparkSession.createDataFrame([(name, str(e)[:500])], "block string, reason string")}
        out.update(got if isinstance(got, dict) else {name: got})

    if "descriptive" in kinds:
        if nums:
            out["descriptive_numeric"] = D.describe_full(df, nums)
        if cats:
            out["descriptive_categorical"] = D.describe_categorical(df, cats)
    if "correlations" in kinds and len(nums) > 1:
        kept = R.kept_columns(df, nums)
        out["correlation_columns"] = R.corr_columns(df, nums)
        if len(kept) >= 2:
            out["pearson"] = R.corr_pearson(df, kept)
            out["spearman"] = R.corr_spearman(df, kept)
            block("kendall", lambda: corr_kendall(df, kept))
            out["significant_correlations"] = R.corr_significant(df, kept, screen=False)
            out["target_correlations"] = R.corr_target(df, kept, screen=False)
    if "distributions" in kinds and nums:
        out["distributions"] = H.distribution_traits(df, nums)
        out["anderson"] = H.normality_anderson(df, nums)
        out["ks"] = H.normality_ks(df, nums)
    if "outliers" in kinds and nums and key:
        out["outliers_iqr"] = O.outliers_iqr(df, key, nums)
        out["outliers_zscore"] = O.outliers_zscore(df, key, nums)
        block("outliers_isolation_forest", lambda: outliers_isolation_forest(df, key, nums))
    if "time_series" in kinds:
        tcols = time_columns(df)
        if tcols:
            roles = TS.ts_columns(df, tcols[0], params.max_series).collect()
            vals = [r.column_name for r in roles if r.role == "value"]
            if vals:
                ser = TS.resample(df, tcols[0], vals, "auto").checkpoint(eager=True)
                timed = df.filter(f"`{tcols[0]}` IS NOT NULL").count()
                out["ts_series"] = ser
                out["ts_status"] = TS.ts_status(ser)
                ser = TS.usable_series(ser)
                out["ts_trend"] = TS.ts_trend(ser)
                out["ts_acf_summary"] = TS.ts_acf_summary(ser)
                out["ts_adf"] = TS.ts_adf(ser)
                out["ts_range"] = TS.ts_range(df, tcols[0])
                out["ts_strength"] = TS.ts_strength_auto(ser, timed)
                out["ts_pacf"] = ts_pacf(ser)
                out["ts_forecast"] = forecast(ser)
    if "hypothesis_tests" in kinds and nums:
        alpha_conf = params.confidence_level
        block("normality", lambda: H.normality_tests(df, nums, alpha_conf))
        if len(nums) >= 2:
            block("comparisons", lambda: H.compare_pairs(df, nums, alpha_conf))
        if cats:
            block("anova", lambda: H.anova_oneway(df, cats, nums))
    if "pca" in adv and len(nums) > 2:
        block("pca", lambda: M.pca(df, nums, key))
    if "famd" in adv and nums and cats:
        block("famd", lambda: M.famd(df, nums, cats))
    if "clustering" in adv and len(nums) > 1:
        block("clustering", lambda: _clusters(df, nums))
    if "regression" in adv and len(nums) > 1:
        block("mutual_information", lambda: H.mutual_information(df, nums))
        block("importance_correlation", lambda: H.importance_correlation(df, nums))
    return out


def full_analysis(df: DataFrame, params: AnalysisParams | None = None, key: str | None = None,
                  mapping: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The whole run of the reference's button: column categories, preprocessing, analyses, findings and report rows.

    ``mapping`` (column -> category) overrides the inferred categories.  Analyses run on the
    processed table, which is written once.
    """
    params = params or AnalysisParams()
    ensure_checkpoint_dir(df.sparkSession)
    if (spread := ensure_parallelism(df)) is not df:  # read in fewer tasks than cores: spread once for all scans
        df = spread.checkpoint(eager=True)
    categories = P.column_categories(df)
    known = {r.column_name: r.category for r in categories.collect()} | (mapping or {})  # one row a column
    if key:
        known.pop(key, None)
    processed = preprocess(df, known, params, key).checkpoint(eager=True)
    out = {"categories": categories, "processed": processed, **analyze(processed, params, key)}
    if "significant_correlations" in out:
        out["findings"] = X.findings(out["significant_correlations"], out.get("outliers_iqr"))
    out["report"] = X.report_rows({k: v for k, v in out.items() if k not in ("categories", "processed")})
    return out


def _clusters(df: DataFrame, nums: list[str]) -> dict[str, DataFrame]:
    """The sweep, the profile of its best k, and DBSCAN."""
    sweep = M.kmeans_sweep(df, nums)
    best = sweep.filter("is_best").first()["k"]
    return {"kmeans_sweep": sweep, "kmeans_profile": M.kmeans_profile(df, best, nums),
            **{f"dbscan_{k}": v for k, v in dbscan_summary(df, nums).items()}}
