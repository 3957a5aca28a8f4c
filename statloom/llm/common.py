"""Helpers shared by the training-data operators: shared scratch tables, fresh column choice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` (with Parquet's ``options``) to the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor can reach, evaluates the
    input once, and leaves later stages recoverable when an executor is lost.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty); whatever else the table has cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def crc_mod(id_expr, n: int):
    """crc32 of the id written as text, modulo ``n`` (a null id: the crc of the empty string)."""
    return F.crc32(F.coalesce(id_expr.cast("string"), F.lit("")).cast("binary")) % n
