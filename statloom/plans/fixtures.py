"""Derived frames used by the registered queries, in Spark and in SQL.

Each frame is built from the driver tables identically in both engines so the
DuckDB oracle can recompute a query from the same input.  ``sql(name)``
returns a ``name AS (...)`` common-table-expression body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.components import materialize

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders_nulls(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(k % 7 == 0, None).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 11 == 0, None).otherwise(F.col("o_orderdate")).alias("o_orderdate"),
        F.when(k % 5 == 0, None).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 3 == 0, F.col("o_totalprice") / 1000.0).alias("mostly_null"),
        F.when(k % 50 == 0, F.col("o_custkey").cast("double")).alias("sparse"))


_ORDERS_NULLS_SQL = """SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate END AS o_orderdate,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 1000.0 END AS mostly_null,
  CASE WHEN o_orderkey % 50 = 0 THEN CAST(o_custkey AS DOUBLE) END AS sparse
FROM orders"""


def _events_text(spark, sf):
    e = table(spark, sf, "events")
    bad = F.col("event_id") % 13 == 0
    return e.select(
        "event_id",
        F.when(bad, F.lit("bad")).otherwise(F.col("ts").cast("string")).alias("ts_txt"),
        F.when(bad, F.lit("bad")).otherwise(F.col("value").cast("string")).alias("value_txt"),
        "event_type")


_EVENTS_TEXT_SQL = """SELECT event_id,
  CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE CAST(ts AS VARCHAR) END AS ts_txt,
  CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS value_txt,
  event_type
FROM events"""


def _order_rollup(spark, sf):
    # sums of two-decimal amounts in DECIMAL: exact, so independent of row order
    li = table(spark, sf, "lineitem")
    dec = lambda c: F.col(c).cast("decimal(18,2)")
    return li.groupBy(F.col("l_orderkey").alias("o_key")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(dec("l_quantity")).cast("double").alias("sum_qty"),
        F.sum(dec("l_extendedprice")).cast("double").alias("sum_price"),
        (F.sum(dec("l_discount")).cast("double") / F.count(F.lit(1))).alias("avg_disc"))


_ORDER_ROLLUP_SQL = """SELECT l_orderkey AS o_key, count(*) AS n_lines,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_disc
FROM lineitem GROUP BY l_orderkey"""


def _part_numeric(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("seq_no"), "p_size",
                                           "p_retailprice")


_PART_NUMERIC_SQL = "SELECT p_partkey AS seq_no, p_size, p_retailprice FROM part"


def _customer_mix(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey",
                                               "c_mktsegment")


_CUSTOMER_MIX_SQL = "SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM customer"


def _events_daily(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("series"),
                     F.date_trunc("day", "ts").alias("bucket")).agg(F.avg("value").alias("v"))


_EVENTS_DAILY_SQL = """SELECT event_type AS series, date_trunc('day', ts) AS bucket, avg(value) AS v
FROM events GROUP BY 1, 2"""


def _orders_weekly(spark, sf):
    o = table(spark, sf, "orders")
    b = F.date_trunc("week", "o_orderdate") + F.expr("INTERVAL 6 DAYS")
    return o.groupBy(F.lit("o_totalprice").alias("series"), b.alias("bucket")).agg(
        F.avg("o_totalprice").alias("v"))


_ORDERS_WEEKLY_SQL = """SELECT 'o_totalprice' AS series,
  date_trunc('week', o_orderdate) + INTERVAL 6 DAY AS bucket, avg(o_totalprice) AS v
FROM orders GROUP BY 1, 2"""


def _dup_rows(spark, sf):
    o = table(spark, sf, "orders")
    return o.unionByName(o.filter(F.col("o_orderkey") % 10 == 0))


_DUP_ROWS_SQL = "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0"


def _vec_2d(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.element_at("embedding", 1).cast("double").alias("x"),
                    F.element_at("embedding", 2).cast("double").alias("y"), "label")


_VEC_2D_SQL = """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
  label FROM embeddings"""


def _vec_8d(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(8)], "label")


_VEC_8D_SQL = "SELECT vec_id, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS x{i}" for i in range(8)) + ", label FROM embeddings"


def _customer_gaps(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    return c.select("c_custkey", F.when(k % 6 != 0, F.col("c_acctbal")).alias("c_acctbal"),
                    F.when(k % 10 != 1, F.col("c_nationkey")).alias("c_nationkey"),
                    F.when(k % 15 != 1, F.length("c_mktsegment") * 100.0 + k % 7).alias("seg"))


_CUSTOMER_GAPS_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 10 <> 1 THEN CAST(c_nationkey AS DOUBLE) END AS c_nationkey,
  CASE WHEN c_custkey % 15 <> 1 THEN CAST(length(c_mktsegment) AS DOUBLE) * 100.0::DOUBLE + c_custkey % 7 END AS seg FROM customer"""


def _doc_lines(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


_DOC_LINES_SQL = """SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos,
  unnest(string_split(text, chr(10))) AS line FROM documents"""


FRAMES = {
    "orders_nulls": (_orders_nulls, _ORDERS_NULLS_SQL),
    "events_text": (_events_text, _EVENTS_TEXT_SQL),
    "order_rollup": (_order_rollup, _ORDER_ROLLUP_SQL),
    "part_numeric": (_part_numeric, _PART_NUMERIC_SQL),
    "customer_mix": (_customer_mix, _CUSTOMER_MIX_SQL),
    "events_daily": (_events_daily, _EVENTS_DAILY_SQL),
    "orders_weekly": (_orders_weekly, _ORDERS_WEEKLY_SQL),
    "dup_rows": (_dup_rows, _DUP_ROWS_SQL),
    "vec_2d": (_vec_2d, _VEC_2D_SQL),
    "vec_8d": (_vec_8d, _VEC_8D_SQL),
    "customer_gaps": (_customer_gaps, _CUSTOMER_GAPS_SQL),
    "doc_lines": (_doc_lines, _DOC_LINES_SQL),
}


#: Grouped frames that their queries read several times: written once.
WRITTEN = {"order_rollup"}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in FRAMES:
        df = FRAMES[name][0](spark, sf_dir)
        return materialize(df) if name in WRITTEN else df
    return table(spark, sf_dir, name)


def sql(*names: str) -> str:
    """``WITH`` prefix defining the named derived frames (base tables are views)."""
    parts = [f"{n} AS ({FRAMES[n][1]})" for n in names]
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""
