"""Sources and sinks.

Readers and writers use Spark's own formats; scratch output goes under the
session's reliable checkpoint directory (a shared folder on a cluster).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.functions.ranks import global_row_number
from statloom.session import ensure_checkpoint_dir, ensure_parallelism

# Encodings tried in order by the reference; first that decodes wins.
ENCODINGS = ["utf-8", "latin-1", "iso-8859-1", "cp1252"]
CHUNK_SIZE = 1000
PREVIEW_ROWS = 100


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the checkpoint directory (shared storage)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/statloom-out/{name}-{uuid.uuid4().hex[:12]}"


def detect_encoding(spark: SparkSession, path: str) -> str:
    """S1 helper: UTF-8 unless some line is not valid UTF-8, then ISO-8859-1.

    Spark's text source keeps the raw bytes, so a line is invalid exactly when
    decoding it and encoding it back as UTF-8 does not give the same bytes
    (one distributed scan, stops at the first hit).  Latin-1 decodes every
    byte, which is why the reference never reaches its last candidate.
    """
    v = F.col("value")
    bad = (spark.read.text(path).filter(F.encode(v, "UTF-8") != v.cast("binary"))
           .limit(1).count())
    return "utf-8" if bad == 0 else "iso-8859-1"


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read a table and make sure the first stage runs on every core."""
    return ensure_parallelism(spark.read.format(fmt).load(path))


def has_quoted_newlines(spark: SparkSession, path: str, encoding: str = "utf-8") -> bool:
    """Whether some line ends inside a quoted field: it holds an odd number of quotes (one scan, stops at the first)."""
    lines = spark.read.option("encoding", encoding).text(path)
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not lines.filter(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, schema=None, encoding: str | None = None,
             multi_line: bool | None = None) -> DataFrame:
    """CSV with a header; types inferred unless ``schema`` is given.

    Quotes inside quotes are doubled, and quoted fields may hold newlines.  Spark
    splits large files inside unless a field holds a newline, which a scan of
    the lines tells (``multi_line`` None); files with one are a task each.
    """
    enc = encoding or detect_encoding(spark, path)
    if multi_line is None:
        multi_line = has_quoted_newlines(spark, path, enc)
    r = spark.read.option("header", True).option("encoding", enc).option("mode", "PERMISSIVE")
    r = r.option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


def preview_topn(df: DataFrame, order: list[str], n: int = PREVIEW_ROWS) -> DataFrame:
    """First ``n`` rows in an explicit order (distributed top-n)."""
    return df.orderBy(*order).limit(n)


def export_json(results: dict[str, DataFrame], path: str) -> dict[str, str]:
    """S3: one JSON-lines folder per result frame."""
    out = {}
    for name, df in results.items():
        p = f"{path.rstrip('/')}/{name}"
        df.write.mode("overwrite").json(p)
        out[name] = p
    return out


def export_bundle(results: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """One sub-folder per sheet name, in Parquet or CSV."""
    out = {}
    for name, df in results.items():
        p = f"{path.rstrip('/')}/{name}"
        w = df.write.mode("overwrite")
        (w.option("header", True).option("escape", '"').csv(p) if fmt == "csv" else w.format(fmt).save(p))
        out[name] = p
    return out


def bundle_sheets(df: DataFrame, order: list[str], descriptive: DataFrame, pearson: DataFrame, insights: DataFrame,
                  sample_rows: int = 1000) -> dict[str, DataFrame]:
    """The reference's five sheets: first rows, descriptive statistics, correlations, insights and a summary."""
    summary = df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        F.current_date().alias("analysis_date"), "total_rows", F.lit(len(df.columns)).alias("total_columns"))
    return {"data_sample": preview_topn(df, order, sample_rows), "descriptive": descriptive, "pearson": pearson,
            "insights": insights, "summary": summary}


def chunk_ids(df: DataFrame, order: list[str], size: int = CHUNK_SIZE) -> DataFrame:
    """``chunk_id = (row_number - 1) div size`` over a total order."""
    rn = global_row_number(df, order)
    return rn.withColumn("chunk_id", F.floor((F.col("row_number") - 1) / size).cast("long"))


def chunk_counts(df: DataFrame, order: list[str], size: int = CHUNK_SIZE) -> DataFrame:
    return chunk_ids(df, order, size).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows"))


def row_hash(cols: list[str]) -> F.Column:
    """SHA-256 of the row's fields joined by U+001F (NULL written as ``\\N``)."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N"))
                                         for c in cols]), 256)


def table_fingerprint(df: DataFrame, cols: list[str] | None = None, by: list[str] | None = None
                      ) -> DataFrame:
    """Order-insensitive content fingerprint: the sum of the first 15 hex
    digits of every row hash (as an exact decimal), with the row count."""
    cols = cols or df.columns
    by = by or []
    h = F.conv(F.substring(row_hash(cols), 1, 15), 16, 10).cast("decimal(38,0)")
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(F.count(F.lit(1)).alias("rows"), F.sum(h).cast("string").alias("fingerprint"))
