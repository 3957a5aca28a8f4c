"""Target encoding (C13's alternative for high cardinality), out of fold, in one grouped pass.

Every row's category becomes the mean target of the same category in the *other*
folds, drawn towards the mean of all rows of those folds by ``smoothing`` rows:

    (sum_v - sum_v,fold + smoothing * mean_-fold) / (n_v - n_v,fold + smoothing)

One group-by on (category, fold) holds all sums; totals per category and per fold
are windows over that small table.  The encoded values join back by category and
fold: categories with at least a ``HOT`` part of all rows (so at most 1 / HOT of
them) are broadcast, all others are joined by shuffle, so no category is a hot key.

Cases: a null category is a category of its own; rows without a target are
encoded but teach nothing; a category that the other folds do not hold gets their
mean; without any target the value is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.exprs import num

FOLDS = 5
SMOOTHING = 10.0
#: Share of all rows from which a category is joined by broadcast.
HOT = 0.001


def fold_of(key: str, folds: int):
    """Fold of a row by the crc32 of its key: the same in every run."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)).cast("int")


def encodings(df: DataFrame, column: str, target: str, fold, smoothing: float = SMOOTHING) -> DataFrame:
    """``(level, fold, rows, encoded)`` of every category in every fold that holds it."""
    y = num(target)
    g = df.select(F.col(column).alias("level"), fold.alias("fold"), y.alias("y")).groupBy("level", "fold").agg(
        F.count("*").alias("rows"), F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("s"))
    w = Window.partitionBy("level")  # at most one row a fold
    folds = g.groupBy("fold").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))
    all_folds = Window.partitionBy(F.lit(0))  # one row a fold
    rest = folds.select("fold", F.try_divide(F.sum("fs").over(all_folds) - F.col("fs"),
                                             F.sum("fn").over(all_folds) - F.col("fn")).alias("mean"))
    g = g.withColumns({"n": F.sum("n").over(w) - F.col("n"), "s": F.sum("s").over(w) - F.col("s")})
    g = g.join(F.broadcast(rest), "fold")
    return g.select("level", "fold", "rows", F.try_divide(
        F.col("s") + F.lit(smoothing) * F.col("mean"), F.col("n") + F.lit(smoothing)).alias("encoded"))


def join_levels(df: DataFrame, table: DataFrame, on: dict[str, str], rows: str = "rows", hot: float = HOT) -> DataFrame:
    """``df`` with the columns of ``table`` whose keys ``on`` (column of df -> column of table) match, nulls too.

    Keys that hold at least ``hot`` of all rows are broadcast, the rest are shuffled.
    """
    total = table.agg(F.sum(rows)).first()[0] or 0
    is_hot = F.col(rows) >= F.lit(max(1.0, total * hot))
    own = [c for c in table.columns if c not in on.values() and c != rows]
    keys = {k: f"_k{i}" for i, k in enumerate(on.values())}
    table = table.select(rows, *own, *[F.col(k).alias(v) for k, v in keys.items()])
    cond = None
    for a, b in on.items():
        c = F.col(a).eqNullSafe(F.col(keys[b]))
        cond = c if cond is None else cond & c
    head = F.broadcast(table.where(is_hot).withColumn("_hot", F.lit(True)).drop(rows))
    first = df.join(head, cond, "left").drop(*keys.values())
    done = first.where("_hot").select(*df.columns, *own)
    left = first.where("_hot IS NULL").select(*df.columns)
    tail = left.join(table.where(~is_hot).drop(rows), cond, "left").select(*df.columns, *own)
    return done.unionByName(tail)


def target_encode(df: DataFrame, columns: list[str], target: str, key: str | None = None, folds: int = FOLDS,
                  smoothing: float = SMOOTHING, fold=None, hot: float = HOT) -> DataFrame:
    """``df`` with ``<column>_target`` for each of ``columns``; ``key`` (or a given ``fold`` number) deals the rows into folds."""
    fold = fold_of(key, folds) if fold is None else fold
    out = df.withColumn("_fold", fold)
    for c in columns:
        table = encodings(df, c, target, fold, smoothing).withColumnRenamed("encoded", f"{c}_target")
        out = join_levels(out, table, {c: "level", "_fold": "fold"}, hot=hot)
    return out.drop("_fold")
