"""Connected components of an edge table by alternating large and small stars.

Every round is a few grouped minima and joins and goes through the shared
checkpoint folder; rounds go on until the edges no longer change (about the
logarithm of the longest path).  Only nodes with a link take part; nothing is
collected but two numbers a round.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: evaluated once, lineage cut."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang the neighbours of every node (all, or those not above it) on its smallest neighbour."""
    near = edges.select(F.col("a").alias("n"), F.col("b").alias("v"))
    if larger_only:
        near = near.unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("v")))
    low = near.groupBy("n").agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
    hung = near.join(low, "n")
    if larger_only:
        return hung.where("v > n").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    own = low.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(own).where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges`` (two long columns ``a``, ``b``).

    Null ends and loops are ignored; an empty edge table gives an empty result.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct())
    mark = None
    while True:
        # both stars keep every edge pointing from a larger node to a smaller one
        now = materialize(_stars(_stars(now, True), False))
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (state.n, state.h) == mark:
            break
        mark = (state.n, state.h)
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.unionByName(roots)
