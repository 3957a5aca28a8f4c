"""Text rows and sources: budget cuts, JSON fallback, points, encodings, chunks."""

import os
import tempfile

from pyspark.sql import functions as F

from statloom.operators import text as X
from statloom.sources import io as S


def test_fit_token_budget_keeps_prefix_below_budget(spark):
    text = "\n".join(["a" * 40] * 10)          # 10 lines of 10 tokens, 110 total chars/4
    df = spark.createDataFrame([(1, text), (2, "short")], "id long, t string")
    out = {r.id: r for r in X.fit_token_budget(df, "t", "id", budget=35).collect()}
    assert out[1].fitted_text == "\n".join(["a" * 40] * 3)   # 30 < 35, 40 would not be
    assert out[2].fitted_text == "short"                        # within budget: unchanged


def test_json_extract_falls_back_to_outer_braces(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, 'noise {"k": 7, "z": {"a": 1}} tail'), (3, "none")],
                               "id long, t string")
    got = {r.id: r.k for r in X.json_extract(df, "t", {"k": "bigint"}, "id").collect()}
    assert got == {1: 3, 2: 7, 3: None}


def test_text_points_split_and_titles(spark):
    body = "1. " + "x" * 60 + " 2. short one 3. " + "y" * 25
    df = spark.createDataFrame([(1, body)], "id long, t string")
    pts = X.text_points(df, "t", ["id"]).orderBy("pos").collect()
    assert [len(p.description) for p in pts] == [60, 25]
    assert pts[0].title == "x" * 50 + "..." and pts[1].title == "y" * 25


def test_encoding_detection_and_csv_read(spark):
    d = tempfile.mkdtemp(prefix="statloom-test-")
    p = os.path.join(d, "latin.csv")
    with open(p, "wb") as f:
        f.write("name,v\ncafé,1\nnaïve,2\n".encode("latin-1"))
    assert S.detect_encoding(spark, p) == "iso-8859-1"
    rows = S.read_csv(spark, p).orderBy("v").collect()
    assert [r.name for r in rows] == ["café", "naïve"]


def test_chunks_and_fingerprint_order_insensitive(spark):
    df = spark.range(0, 2500).select(F.col("id"), (F.col("id") % 7).cast("string").alias("s"))
    counts = {r.chunk_id: r.rows for r in S.chunk_counts(df, ["id"]).collect()}
    assert counts == {0: 1000, 1: 1000, 2: 500}
    a = S.table_fingerprint(df).first()
    b = S.table_fingerprint(df.orderBy(F.desc("id")).repartition(3)).first()
    assert a.fingerprint == b.fingerprint and a.rows == 2500
