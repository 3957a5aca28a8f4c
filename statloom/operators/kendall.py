"""Kendall tau-b without forming pairs.

``S = sum_{i<j} sgn(x_i - x_j) sgn(y_i - y_j) = 2A - (n0 - n1) + (n2 - n3)``
where ``A`` counts ordered pairs with ``x_i < x_j`` *and* ``y_i < y_j``,
``n0 = n(n-1)/2`` and ``n1``, ``n2``, ``n3`` are the pairs tied in x, in y and
in both (all from group-by counts).  ``A`` is a strict 2-D dominance count:

1. cells ``(x, y, c)`` are range-partitioned by (x, y falling) into blocks and
   written through the reliable checkpoint; cells of equal x that a cut separates
   are never in dominating order, so one x that most rows share is cut too;
2. inside each block the dominated pairs are counted by a vectorised
   divide-and-conquer over the x groups (one pandas task per block, bounded
   by the range size);
3. the blocked cells are range-partitioned by (y, block falling); inside a range the same
   routine, keyed by block id, counts points of strictly earlier blocks with
   strictly smaller y;
4. points of strictly earlier blocks *and* strictly earlier y-ranges are a
   dominance count over the ``Q x B`` grid of (block, range) counts, far
   smaller than the cells: the whole procedure is applied to it again.

Total work is O(n log^2 n), no task holds more than one range and nothing but
scalars reaches the driver.  Counts of pairs pass 2^63 on large tables, so
they are summed as decimals and as Python integers.
"""

from __future__ import annotations

import math
from decimal import Decimal
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.exprs import clean_numeric, numeric_columns
from statloom.session import ensure_checkpoint_dir

CELLS_PER_BLOCK = 500_000


def dominance_weighted(g: np.ndarray, r: np.ndarray, c: np.ndarray) -> int:
    """``sum_j c_j * sum_i c_i [g_i < g_j and r_i < r_j]`` for integer keys, vectorised.

    Divide and conquer over the group key, one level at a time: at level L
    the groups split into pairs of halves (``g >> (L+1)``, side ``(g >> L) & 1``);
    within every pair, left points with a strictly smaller ``r`` are counted for
    each right point by one sort and a cumulative sum.  O(n log^2 n) numpy
    work, no per-point Python.
    """
    if len(g) < 2:
        return 0
    g = np.asarray(g, dtype=np.int64)
    g = g - g.min()
    r = np.asarray(r, dtype=np.int64)
    c = np.asarray(c, dtype=np.int64)
    total = 0
    levels = int(g.max()).bit_length()
    for L in range(levels):
        pair = g >> (L + 1)
        side = (g >> L) & 1
        # order: pair, then r, right before left on equal r (strict inequality)
        order = np.lexsort((-side, r, pair))
        p_s, s_s, c_s = pair[order], side[order], c[order]
        left_w = np.where(s_s == 0, c_s, 0)
        cum = np.cumsum(left_w)
        start = np.r_[0, np.flatnonzero(np.diff(p_s)) + 1]
        base = np.repeat(cum[start] - left_w[start], np.diff(np.r_[start, len(p_s)]))
        before = cum - left_w - base          # left weight strictly before this point in its pair
        right = s_s == 1
        total += _exact_dot(c_s[right], before[right])
    return total


def _exact_dot(a: np.ndarray, b: np.ndarray) -> int:
    """Sum of products of counts, in 64 bits where they suffice."""
    if float(a.astype(float) @ b.astype(float)) < 2.0 ** 62:
        return int(a @ b)
    return int(a.astype(object) @ b.astype(object))


def _count(keys: list[str]):
    """Dominated pairs of the cells of one task, by two columns, as one decimal."""
    def run(it):
        frames = [pdf for pdf in it]
        if not frames:
            return
        pdf = pd.concat(frames)
        g, r = (pd.factorize(pdf[k], sort=True)[0] for k in keys)
        yield pd.DataFrame({"a": [Decimal(dominance_weighted(g, r, pdf["c"].to_numpy(np.int64)))]})
    return run


def _total(df: DataFrame, keys: list[str]) -> int:
    return int(df.select(*keys, "c").mapInPandas(_count(keys), "a decimal(38,0)").agg(F.sum("a")).first()[0] or 0)


def dominance_count(cells: DataFrame, cells_per_block: int = CELLS_PER_BLOCK) -> int:
    """``A = sum c_i c_j [x_i < x_j and y_i < y_j]`` over cells ``(x, y, c)``."""
    ensure_checkpoint_dir(cells.sparkSession)
    cells = cells.checkpoint(eager=True)
    m = cells.count()
    if m == 0:
        return 0
    blocks = max(1, -(-m // cells_per_block))
    blocked = (cells.repartitionByRange(blocks, F.col("x"), F.col("y").desc()).withColumn("_b", F.spark_partition_id())
               .checkpoint(eager=True))
    total = _total(blocked, ["x", "y"])
    if blocks == 1:
        return total
    swept = (blocked.repartitionByRange(blocks, F.col("y"), F.col("_b").desc()).withColumn("_q", F.spark_partition_id())
             .checkpoint(eager=True))
    total += _total(swept, ["_b", "y"])
    grid = swept.groupBy(F.col("_b").alias("x"), F.col("_q").alias("y")).agg(F.sum("c").alias("c"))
    # at most blocks^2 cells: smaller than what it was made from while a block holds more cells than there are blocks
    return total + dominance_count(grid, max(cells_per_block, blocks + 1))


def _tied_pairs(g: DataFrame, keys: list[str]) -> int:
    t = F.col("t").cast("decimal(19,0)")
    r = g.groupBy(*keys).agg(F.sum("c").alias("t")).agg(
        F.sum((t * (t - 1)).cast("decimal(38,0)")).alias("p")).first()[0]
    return int(r or 0) // 2


def corr_kendall(df: DataFrame, cols: list[str] | None = None,
                 cells_per_block: int = CELLS_PER_BLOCK) -> DataFrame:
    """Tau-b for every pair i < j over pairwise-complete rows, any table size."""
    cols = cols or numeric_columns(df)
    x = clean_numeric(df, cols)
    rows = []
    for a, b in combinations(cols, 2):
        pts = x.select(F.col(a).alias("x"), F.col(b).alias("y")).na.drop()
        cells = pts.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
        n = int(cells.agg(F.sum("c")).first()[0] or 0)
        if n < 2:
            rows.append((a, b, n, None))
            continue
        n0 = n * (n - 1) // 2
        n1, n2 = _tied_pairs(cells, ["x"]), _tied_pairs(cells, ["y"])
        n3 = _tied_pairs(cells, ["x", "y"])
        s = 2 * dominance_count(cells, cells_per_block) - (n0 - n1) + (n2 - n3)
        den = math.sqrt((n0 - n1) * (n0 - n2))
        rows.append((a, b, n, (s / den) if den > 0 else None))
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, n long, tau double")
