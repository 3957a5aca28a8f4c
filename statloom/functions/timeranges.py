"""Series cut into ranges of time, so that no series has to fit one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that one task takes.
RANGE = 500_000


def time_ranges(series: DataFrame, per_range: int = RANGE) -> DataFrame:
    """series, bucket, v, part: ranges of (series, bucket), written with their number; missing values are left out."""
    rows = series.select("series", "bucket", F.col("v").cast("double").alias("v"))
    rows = rows.where("v IS NOT NULL AND NOT isnan(v)").checkpoint(eager=True)
    parts = max(1, -(-rows.count() // per_range))
    cut = rows.repartitionByRange(parts, "series", "bucket")
    return cut.withColumn("part", F.spark_partition_id()).checkpoint(eager=True)
