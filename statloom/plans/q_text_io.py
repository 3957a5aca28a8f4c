"""Registered queries: text rows (X1-X7) and sources / sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from statloom.operators import correlate as R
from statloom.operators import describe as D
from statloom.operators import outliers as O
from statloom.operators import text as X
from statloom.plans.catalog import register
from statloom.plans.fixtures import frame, sql
from statloom.plans.q_describe import FULL_DBL, LINEITEM_NUM
from statloom.plans import sqlgen
from statloom.sources import io as S


@register("token_estimate", sql="""SELECT lang, source, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY 1, 2""")
def token_estimate(spark, sf):
    return X.token_estimate(frame(spark, sf, "documents"), "text", ["lang", "source"])


@register("token_estimate_conv", sql="""SELECT conv_id, count(*) AS n_texts, CAST(sum(length(text)) AS BIGINT) AS chars,
  CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY 1""")
def token_estimate_conv(spark, sf):
    return X.token_estimate(frame(spark, sf, "conversations"), "text", ["conv_id"])


@register("fit_token_budget", sql="""WITH l AS (SELECT doc_id, pos, line,
  sum(length(line) // 4) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM (SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos,
    unnest(string_split(text, chr(10))) AS line FROM documents)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS kept FROM l WHERE run < 8000 GROUP BY 1)
SELECT d.doc_id, CAST(length(d.text) // 4 AS BIGINT) AS tokens_before,
  CASE WHEN length(d.text) // 4 > 8000 THEN coalesce(k.kept, '') ELSE d.text END AS fitted_text,
  CAST(length(CASE WHEN length(d.text) // 4 > 8000 THEN coalesce(k.kept, '') ELSE d.text END) // 4 AS BIGINT) AS tokens_after
FROM documents d LEFT JOIN k USING (doc_id)""")
def fit_token_budget(spark, sf):
    return X.fit_token_budget(frame(spark, sf, "documents"), "text", "doc_id")


@register("json_extract", sql="SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return X.json_extract(frame(spark, sf, "events"), "props", {"k": "bigint"}, "event_id")


@register("text_points", sql=r"""SELECT conv_id, turn, pos, CASE WHEN length(d) > 50 THEN substr(d, 1, 50) || '...' ELSE d END AS title,
  d AS description FROM (
  SELECT conv_id, turn, CAST(pos - 1 AS INTEGER) AS pos, regexp_replace(piece, '^\s+|\s+$', '', 'g') AS d FROM (
    SELECT conv_id, turn, unnest(generate_series(1, len(regexp_split_to_array(text, '\d+\.|•|▪|-\s')))) AS pos,
      unnest(regexp_split_to_array(text, '\d+\.|•|▪|-\s')) AS piece FROM conversations))
WHERE pos < 10 AND length(d) > 20""")
def text_points(spark, sf):
    return X.text_points(frame(spark, sf, "conversations"), "text", ["conv_id", "turn"])


@register("text_digest", sql="""SELECT conv_id, string_agg(part, chr(10) || chr(10) ORDER BY turn) AS digest FROM (
  SELECT conv_id, turn, CASE WHEN length(string_split(text, chr(10))[1]) > 200
    THEN substr(string_split(text, chr(10))[1], 1, 200) || '...' ELSE string_split(text, chr(10))[1] END AS part
  FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 5) GROUP BY conv_id""")
def text_digest(spark, sf):
    return X.text_digest(frame(spark, sf, "conversations"), "text", "conv_id", "turn")


_ROLL = ["o_key", "n_lines", "sum_qty", "sum_price", "avg_disc"]


@register("findings", sql=sql("order_rollup") + """SELECT CAST(1 AS INTEGER) AS rank, 'correlation' AS kind,
  'Strong correlation between n_lines and sum_qty' AS title, printf('%.2f', corr(n_lines, sum_qty)) AS detail,
  abs(corr(n_lines, sum_qty)) AS confidence, CASE WHEN abs(corr(n_lines, sum_qty)) > 0.7 THEN 'high' ELSE 'medium' END AS impact
FROM order_rollup""", sig_cols=["confidence"])
def findings(spark, sf):
    r = frame(spark, sf, "order_rollup")
    return X.findings(R.corr_significant(r, _ROLL, with_p=False))


_FENCE = """(SELECT count(*) FROM order_rollup, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM order_rollup)
  WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))"""


@register("findings_with_outliers", sql=sql("order_rollup") + """SELECT CAST(1 AS INTEGER) AS rank, 'correlation' AS kind,
  'Strong correlation between n_lines and sum_qty' AS title, printf('%.2f', corr(n_lines, sum_qty)) AS detail,
  abs(corr(n_lines, sum_qty)) AS confidence, CASE WHEN abs(corr(n_lines, sum_qty)) > 0.7 THEN 'high' ELSE 'medium' END AS impact
FROM order_rollup UNION ALL
SELECT 4, 'outliers', 'Outliers detected in the dataset', n || ' outlying values', CAST(0.8 AS DOUBLE), 'medium'
FROM (SELECT """ + " + ".join(_FENCE.format(c=c) for c in ("n_lines", "sum_qty")) + """ AS n) WHERE n > 0""", sig_cols=["confidence"])
def findings_with_outliers(spark, sf):
    r = frame(spark, sf, "order_rollup")
    return X.findings(R.corr_significant(r, _ROLL), O.outliers_iqr(r, "o_key", ["n_lines", "sum_qty"]))


@register("report_rows", sql=sql("order_rollup") + """SELECT 'analyses' AS section, CAST(1 AS INTEGER) AS rank, 'findings' AS title, CAST(NULL AS VARCHAR) AS value
UNION ALL SELECT 'analyses', 2, 'significant_correlations', NULL
UNION ALL SELECT 'correlations', 1, 'significant correlations', CAST(count(*) AS VARCHAR) FROM (SELECT corr(n_lines, sum_qty) AS r, count(*) AS n FROM order_rollup)
  WHERE abs(r) > 0.3 AND abs(r) < 0.99 AND n > 3
UNION ALL SELECT 'findings', 1, 'Strong correlation between n_lines and sum_qty', printf('%.2f', corr(n_lines, sum_qty)) FROM order_rollup""")
def report_rows(spark, sf):
    r = frame(spark, sf, "order_rollup")
    sc = R.corr_significant(r, _ROLL)
    return X.report_rows({"significant_correlations": sc, "findings": X.findings(sc)})


_ORD_AGG = """SELECT count(*) AS n_rows, CAST(sum(o_custkey) AS BIGINT) AS sum_custkey,
  sum(o_totalprice) AS sum_price, count(DISTINCT o_orderpriority) AS n_priority FROM {src}"""


@register("csv_roundtrip", sql=_ORD_AGG.format(src="orders"), sig_cols=["sum_price"])
def csv_roundtrip(spark, sf):
    p = S.write_csv(frame(spark, sf, "orders"), S.scratch_path(spark, "csv"))
    back = S.read_csv(spark, p)
    return back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("o_custkey").cast("long").alias("sum_custkey"),
                    F.sum("o_totalprice").alias("sum_price"),
                    F.countDistinct("o_orderpriority").alias("n_priority"))


@register("preview_topn", sql="SELECT * FROM orders ORDER BY o_orderkey LIMIT 100", sig_cols=["o_totalprice"])
def preview_topn(spark, sf):
    return S.preview_topn(frame(spark, sf, "orders"), ["o_orderkey"])


@register("export_json", sql=sqlgen.describe_full_sql("lineitem", LINEITEM_NUM), sig_cols=FULL_DBL)
def export_json(spark, sf):
    res = {"descriptive": D.describe_full(frame(spark, sf, "lineitem"), LINEITEM_NUM)}
    paths = S.export_json(res, S.scratch_path(spark, "json"))
    back = spark.read.json(paths["descriptive"])
    return back.select(*[F.col(c).cast("long") if c in ("count", "nulls") else
                         (F.col(c) if c == "column_name" else F.col(c).cast("double"))
                         for c in back.columns])


@register("export_bundle_summary", sql=sql("order_rollup") + """SELECT 'data_sample' AS sheet, count(*) AS rows FROM (SELECT * FROM lineitem LIMIT 1000)
UNION ALL SELECT 'descriptive', 8
UNION ALL SELECT 'pearson', count(*) FROM (SELECT 1 FROM (VALUES (1),(2),(3),(4),(5),(6)))""")
def export_bundle_summary(spark, sf):
    li = frame(spark, sf, "lineitem")
    res = {"data_sample": S.preview_topn(li, ["l_orderkey", "l_linenumber", "l_partkey"], 1000),
           "descriptive": D.describe_full(li, LINEITEM_NUM),
           "pearson": R.corr_pearson(frame(spark, sf, "order_rollup"), _ROLL[1:])}
    paths = S.export_bundle(res, S.scratch_path(spark, "bundle"))
    parts = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("sheet"), "rows")
             for k, p in paths.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SHEETS = sql("order_rollup") + f"""SELECT 'data_sample' AS sheet, count(*) AS rows, sum(l_quantity) AS total
FROM (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 1000)
UNION ALL SELECT 'descriptive', count(*), sum(mean) FROM ({sqlgen.describe_full_sql("lineitem", LINEITEM_NUM)})
UNION ALL SELECT 'pearson', 6, corr(n_lines, sum_qty) + corr(n_lines, sum_price) + corr(n_lines, avg_disc)
  + corr(sum_qty, sum_price) + corr(sum_qty, avg_disc) + corr(sum_price, avg_disc) FROM order_rollup
UNION ALL SELECT 'insights', 1, abs(corr(n_lines, sum_qty)) FROM order_rollup
UNION ALL SELECT 'summary', 1, CAST(count(*) + 11 AS DOUBLE) FROM lineitem"""


@register("export_bundle_sheets", sql=_SHEETS, sig_cols=["total"])
def export_bundle_sheets(spark, sf):
    """The five sheets, written, read again and added up."""
    li, roll = frame(spark, sf, "lineitem"), frame(spark, sf, "order_rollup")
    sheets = S.bundle_sheets(li, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"],
                             D.describe_full(li, LINEITEM_NUM), R.corr_pearson(roll, _ROLL[1:]),
                             X.findings(R.corr_significant(roll, _ROLL, with_p=False)))
    paths = S.export_bundle(sheets, S.scratch_path(spark, "bundle"))
    value = {"data_sample": "l_quantity", "descriptive": "mean", "pearson": "r", "insights": "confidence",
             "summary": "total_rows + total_columns"}
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.expr(value[name]).cast("double")).alias("total"))
        one = one.select(F.lit(name).alias("sheet"), "rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


@register("full_analysis_blocks")
def full_analysis_blocks(spark, sf):
    """Every frame of a whole run over the customers, with its rows."""
    from statloom.operators.prepare import AnalysisParams
    from statloom.plans.engine import full_analysis
    params = AnalysisParams(analysis_types=("descriptive", "correlations", "outliers", "hypothesis_tests"))
    out = None
    for name, df in sorted(full_analysis(frame(spark, sf, "customer"), params, key="c_custkey").items()):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("block"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@register("chunk_counts", sql="""SELECT CAST((rn - 1) // 1000 AS BIGINT) AS chunk_id, count(*) AS rows FROM (
  SELECT row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1""")
def chunk_counts(spark, sf):
    return S.chunk_counts(frame(spark, sf, "orders"), ["o_orderkey"])


_FP_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
# types that both engines write alike
_FP_CASTS = {"o_totalprice": "CAST(o_totalprice AS DECIMAL(18, 2))", "o_orderdate": "CAST(o_orderdate AS DATE)"}


@register("table_fingerprint", sql="""SELECT count(*) AS rows, CAST(sum(CAST(CAST('0x' || substr(sha256(concat_ws(chr(31), """
          + ", ".join(f"coalesce(CAST({_FP_CASTS.get(c, c)} AS VARCHAR), '\\N')" for c in _FP_COLS)
          + """)), 1, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint FROM orders""")
def table_fingerprint(spark, sf):
    return S.table_fingerprint(frame(spark, sf, "orders").selectExpr(
        *[f"{_FP_CASTS.get(c, c)} AS {c}" for c in _FP_COLS]))
