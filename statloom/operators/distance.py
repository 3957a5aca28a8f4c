"""Distance correlation (Szekely, Rizzo, Bakirov 2007) without forming pairs.

With a_i and b_i the sums of |x_i - x_j| and |y_i - y_j| over all rows j, the
squared distance covariance is

    sum |x_i - x_j| |y_i - y_j| / n^2  +  sum a_i sum b_i / n^4  -  2 sum a_i b_i / n^3.

a_i and b_i are running sums along the sorted values.  The first sum is
2 (2 C - T): T, the signed products over all unordered pairs, is n sum xy - sum x
sum y, and C, the products over pairs with x_i < x_j and y_i < y_j, opens into
prefix sums of 1, x, y and xy over the dominated points.

C is taken like a count of dominated points, in three parts: pairs inside a range of
x; pairs of different x-ranges inside a range of y; and the grid of both, whose
cells hold the added sums and which is counted the same way, recursively.  Ranges
run by (x, y falling) and (y, x-range falling): pairs of equal x (or y) that such a
cut separates are never in dominating order, so one value that a third of all
rows share is cut like any other.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.exprs import clean_numeric, numeric_columns
from statloom.session import ensure_checkpoint_dir

CELLS_PER_BLOCK = 200_000
SUMS = ["c", "sx", "sy", "sxy"]


def dominated_products(first, second, s: np.ndarray) -> float:
    """Sum of (x_j - x_i)(y_j - y_i), weighted, over i below j in both orders; ``s``: columns c, sx, sy, sxy.

    Halves of growing blocks of the first order are merged by the second, all blocks of a level at once.
    """
    g = np.unique(first, return_inverse=True)[1]
    r = np.unique(second, return_inverse=True)[1]
    total, level = 0.0, 0
    while len(g) and (g.max() >> level):
        side = (g >> level) & 1
        order = np.lexsort((-side, r, g >> (level + 1)))  # of equal second values the upper half comes first
        block, upper, t = (g >> (level + 1))[order], side[order] == 1, s[order]
        below = np.cumsum(np.where(upper[:, None], 0.0, t), axis=0)
        start = np.r_[0, np.flatnonzero(np.diff(block)) + 1]
        carried = np.where((start > 0)[:, None], below[start - 1], 0.0)
        below -= np.repeat(carried, np.diff(np.r_[start, len(block)]), axis=0)
        low, high = below[upper], t[upper]
        total += float((high[:, 3] * low[:, 0] - high[:, 1] * low[:, 2] - high[:, 2] * low[:, 1] + high[:, 0] * low[:, 3]).sum())
        level += 1
    return total


def _inside(df: DataFrame, part: str, first: str, second: str) -> float:
    """The sum over pairs that share a range, one task of work per range."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = dominated_products(pdf[first].to_numpy(), pdf[second].to_numpy(), pdf[SUMS].to_numpy(np.float64))
        return pd.DataFrame({"t": [got]})

    held = df.select(*dict.fromkeys([part, first, second]), *SUMS)
    return held.groupBy(part).applyInPandas(run, "t double").agg(F.sum("t")).first()[0] or 0.0


def _ranged(df: DataFrame, name: str, value: str, order: list, blocks: int, out: str | None = None) -> DataFrame:
    """``df`` cut into ranges of ``order`` numbered ``name``; with ``out``, the sum of the distances of ``value`` to all rows."""
    ranged = df.repartitionByRange(blocks, *order).withColumn(name, F.spark_partition_id()).checkpoint(eager=True)
    if not out:
        return ranged
    spark = df.sparkSession
    per = sorted(ranged.groupBy(name).agg(F.sum("c"), F.sum(F.col("c") * F.col(value))).collect())  # a row a range
    n, s = sum(r[1] for r in per), math.fsum(r[2] for r in per)
    rows, cn, cs = [], 0, 0.0
    for p, a, b in per:
        rows.append((p, cn, cs))
        cn, cs = cn + a, cs + b
    offsets = F.broadcast(spark.createDataFrame(rows, f"{name} int, _n long, _s double"))
    w = Window.partitionBy(name).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    v, c = F.col(value), F.col("c")
    t = ranged.join(offsets, name).withColumns({
        "_n": F.col("_n") + F.sum("c").over(w), "_s": F.col("_s") + F.sum(c * v).over(w)})
    # distances down to the row itself, and up from it
    return t.withColumn(out, (v * F.col("_n") - F.col("_s")) + (F.lit(s) - F.col("_s")) - v * (F.lit(n) - F.col("_n"))).drop("_n", "_s")


def _grid(cells: DataFrame, per_block: int) -> float:
    """The sum over the cells (x, y, sums) of a grid."""
    cells = cells.checkpoint(eager=True)
    m = cells.count()
    if m == 0:
        return 0.0
    blocks = max(1, -(-m // per_block))
    blocked = _ranged(cells, "_b", "x", [F.col("x"), F.col("y").desc()], blocks)
    total = _inside(blocked, "_b", "x", "y")
    return total if blocks == 1 else total + _across(blocked, blocks, per_block)


def _across(blocked: DataFrame, blocks: int, per_block: int) -> float:
    """The sum over pairs of different x-ranges."""
    swept = blocked
    if "_q" not in blocked.columns:
        swept = _ranged(blocked, "_q", "y", [F.col("y"), F.col("_b").desc()], blocks)
    total = _inside(swept, "_q", "_b", "y")
    grid = swept.groupBy(F.col("_b").alias("x"), F.col("_q").alias("y")).agg(*[F.sum(s).alias(s) for s in SUMS])
    # at most blocks^2 cells: fewer than it was made from while a block holds more cells than there are blocks
    return total + _grid(grid, max(per_block, blocks + 1))


def _pair(points: DataFrame, per_block: int) -> tuple[int, float | None, float | None]:
    """n, distance covariance and correlation of the columns x and y."""
    st = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{k}{c}") for c in "xy" for k, f in (
        ("m", F.avg), ("s", F.stddev_pop))]).first()
    n = st.n
    if n < 2:
        return n, None, None
    if not st.sx or not st.sy:
        return n, 0.0, None
    cells = points.groupBy("x", "y").agg(F.count("*").alias("c")).select(
        ((F.col("x") - F.lit(st.mx)) / F.lit(st.sx)).alias("x"), ((F.col("y") - F.lit(st.my)) / F.lit(st.sy)).alias("y"), "c")
    c, x, y = F.col("c"), F.col("x"), F.col("y")
    cells = cells.withColumns({"sx": c * x, "sy": c * y, "sxy": c * x * y}).checkpoint(eager=True)
    blocks = max(1, -(-cells.count() // per_block))
    blocked = _ranged(cells, "_b", "x", [F.col("x"), F.col("y").desc()], blocks, "a").checkpoint(eager=True)
    swept = _ranged(blocked, "_q", "y", [F.col("y"), F.col("_b").desc()], blocks, "b").checkpoint(eager=True)
    up = _inside(blocked, "_b", "x", "y")
    if blocks > 1:
        up += _across(swept, blocks, per_block)
    a, b = F.col("a"), F.col("b")
    t = swept.agg(*[F.sum(e).alias(k) for k, e in {
        "x": c * x, "y": c * y, "xx": c * x * x, "yy": c * y * y, "xy": c * x * y, "a": c * a, "b": c * b,
        "ab": c * a * b, "aa": c * a * a, "bb": c * b * b}.items()]).first()
    signed = n * t.xy - t.x * t.y
    def squared(products, pa, pb, cross):
        return max(0.0, products / n ** 2 + (pa / n ** 2) * (pb / n ** 2) - 2 * cross / n ** 3)
    cov = squared(2 * (2 * up - signed), t.a, t.b, t.ab)
    vx = squared(2 * (n * t.xx - t.x * t.x), t.a, t.a, t.aa)
    vy = squared(2 * (n * t.yy - t.y * t.y), t.b, t.b, t.bb)
    return n, math.sqrt(cov * st.sx * st.sy), math.sqrt(cov / math.sqrt(vx * vy)) if vx > 0 and vy > 0 else None


def corr_distance(df: DataFrame, cols: list[str] | None = None, cells_per_block: int = CELLS_PER_BLOCK) -> DataFrame:
    """``(var1, var2, n, dcov, dcor)`` for every pair of columns, over rows where both are present.

    dcor is null for fewer than two rows or a constant column.
    """
    cols = cols or numeric_columns(df)
    ensure_checkpoint_dir(df.sparkSession)
    x = clean_numeric(df, cols)
    rows = [(p, q, *_pair(x.select(F.col(p).alias("x"), F.col(q).alias("y")).na.drop(), cells_per_block))
            for p, q in combinations(cols, 2)]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, n long, dcov double, dcor double")
