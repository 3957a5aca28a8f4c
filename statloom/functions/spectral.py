"""Largest eigenpairs of a symmetric matrix held as rows (i, j, a), minus an optional u u'.

The matrix of a table's levels is as wide as there are levels, so it is never
widened into columns.  Up to ``DENSE`` indices (a bound that is counted) the matrix is a
few megabytes and the driver solves it; beyond, a block Krylov space is grown:
each step multiplies the last block by the matrix (one join and one grouped sum
over the rows), is made orthogonal to the blocks before (Gram matrices, the only
numbers that reach the driver) and ends when the wanted Ritz values stand still.
Vectors stay a table (i, array).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.components import materialize

DENSE = 1_500
#: Columns of a block beyond the wanted pairs, most blocks, and the relative change that ends the search.
EXTRA = 6
MAX_BLOCKS = 40
TOLERANCE = 1e-10
SEED = 5


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Largest entry of every vector positive."""
    if not vectors.size:
        return vectors
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def top_eigen(entries: DataFrame, nodes: DataFrame, k: int, dense: int = DENSE) -> tuple[np.ndarray, DataFrame]:
    """The k largest eigenvalues and ``(i, vec)``, the rows of their vectors.

    ``entries``: (i, j, a) with both (i, j) and (j, i); ``nodes``: (i, u), every index
    once with its entry of the vector whose outer product is taken off (0: none).
    """
    n = nodes.count()
    k = min(k, n)
    if n <= dense:
        return _dense(entries, nodes, n, k)
    return _krylov(entries, nodes, n, k)


def _dense(entries: DataFrame, nodes: DataFrame, n: int, k: int) -> tuple[np.ndarray, DataFrame]:
    at = sorted(nodes.select("i", "u").collect(), key=lambda r: str(r.i))
    place = {r.i: p for p, r in enumerate(at)}
    m = np.zeros((n, n))
    for i, j, a in entries.select("i", "j", "a").collect():
        m[place[i], place[j]] = a
    u = np.array([r.u for r in at], np.float64)
    m -= np.outer(u, u)
    values, vectors = np.linalg.eigh((m + m.T) / 2) if n else (np.zeros(0), np.zeros((0, 0)))
    vectors = _signed(vectors[:, ::-1][:, :k])
    kind = dict(nodes.dtypes)["i"]
    rows = [(r.i, v.tolist()) for r, v in zip(at, vectors)]
    return values[::-1][:k], nodes.sparkSession.createDataFrame(rows, f"i {kind}, vec array<double>")


def _gram(left: str, right: str, rows: DataFrame, a: int, b: int) -> np.ndarray:
    """left' right, for array columns of a and b entries."""
    pairs = rows.select(F.posexplode(left).alias("p", "x"), F.col(right).alias("r")).select(
        "p", "x", F.posexplode("r").alias("q", "y"))
    got = pairs.groupBy("p", "q").agg(F.sum(F.col("x") * F.col("y")).alias("s")).collect()
    out = np.zeros((a, b))
    for r in got:
        out[r.p, r.q] = r.s
    return out


def _times(column: str, m: np.ndarray):
    """An array column, as a row, times a small matrix."""
    table = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in m.T])
    return F.transform(table, lambda c: F.aggregate(
        F.zip_with(F.col(column), c, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v))


def _multiplied(entries: DataFrame, rows: DataFrame, block: str, width: int) -> DataFrame:
    """``rows`` with ``w``: the matrix times the block."""
    product = entries.join(rows.select(F.col("i").alias("j"), F.col(block).alias("q")), "j").groupBy("i").agg(
        *[F.sum(F.col("a") * F.get("q", F.lit(c))).alias(f"s{c}") for c in range(width)])
    product = product.select("i", F.array(*[f"s{c}" for c in range(width)]).alias("w"))
    taken = rows.agg(*[F.sum(F.col("u") * F.get(block, F.lit(c))).alias(f"t{c}") for c in range(width)]).first()
    less = F.array(*[F.lit(float(taken[c] or 0.0)) for c in range(width)])
    out = rows.join(product, "i", "left")
    whole = F.coalesce("w", F.array_repeat(F.lit(0.0), width))
    return out.withColumn("w", F.zip_with(whole, F.transform(less, lambda t: t * F.col("u")), lambda x, y: x - y))


def _orthonormal(rows: DataFrame, column: str, basis: str | None, width: int, held: int) -> tuple[DataFrame, int]:
    """``column`` made orthogonal to ``basis`` and within itself, twice for rounding; columns that vanish go."""
    for _ in range(2):
        if basis and held:
            rows = rows.withColumn(column, F.zip_with(
                column, _times(basis, _gram(basis, column, rows, held, width)), lambda x, y: x - y))
            rows = materialize(rows)
        values, vectors = np.linalg.eigh(_gram(column, column, rows, width, width))
        keep = values > max(values.max(initial=0.0), 1e-300) * 1e-14
        if not keep.any():
            return rows, 0
        rows = materialize(rows.withColumn(column, _times(column, vectors[:, keep] / np.sqrt(values[keep]))))
        width = int(keep.sum())
    return rows, width


def _krylov(entries: DataFrame, nodes: DataFrame, n: int, k: int) -> tuple[np.ndarray, DataFrame]:
    entries = materialize(entries)
    width = min(n, k + EXTRA)
    start = F.array(*[F.randn(SEED + c) for c in range(width)])
    rows = materialize(nodes.select("i", "u").withColumn("q", start))
    rows, width = _orthonormal(rows, "q", None, width, 0)
    rows = rows.withColumn("basis", F.col("q")).withColumn("image", F.array().cast("array<double>"))
    held, before = width, None
    for _ in range(MAX_BLOCKS):
        rows = materialize(_multiplied(entries, rows, "q", width))
        rows = rows.withColumn("image", F.concat("image", "w"))
        small = _gram("basis", "image", rows, held, held)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        top = values[::-1][:k]
        if held >= n or before is not None and len(before) == len(top) and np.abs(top - before).max() <= TOLERANCE * abs(top[0]):
            break
        before = top
        rows, width = _orthonormal(rows, "w", "basis", width, held)
        if not width:
            break
        rows = rows.withColumns({"q": F.col("w"), "basis": F.concat("basis", "w")}).drop("w")
        held += width
    ritz = vectors[:, ::-1][:, :k]
    found = materialize(rows.select("i", _times("basis", ritz).alias("vec")))
    # largest entry of every vector positive
    low = found.agg(*[F.max_by(F.get("vec", F.lit(c)), F.abs(F.get("vec", F.lit(c)))).alias(f"m{c}") for c in range(len(top))]).first()
    sign = F.array(*[F.lit(-1.0 if low[c] < 0 else 1.0) for c in range(len(top))])
    return top, found.withColumn("vec", F.zip_with("vec", sign, lambda x, s: x * s))
