"""Imputation by the k nearest rows (missing-aware distance), exact.

The distance of two rows is sqrt(d / m * sum of squared differences over the m of d
columns that both have); a missing value becomes the mean of its column over the
k nearest rows that have it, ties by row number.

Rows fall into a grid of quantile bins on the columns with most values; a cell knows the
lowest and highest value of every column.  For a row with gaps, a cell's
rows cannot be nearer than their box is in the columns the row has (a column
that the cell may lack counts nothing).  Rings of cells open in the order of that
bound: first the nearest cells until they hold enough donors, then every cell whose
bound is not above the k-th distance found.  The number of cells is bounded, so
their table (a few numbers each) goes to every task; large cells are cut into
blocks, and the rows that ask a block into as many parts as their number needs, that
meet in separate tasks.

Rows with the same values and gaps ask once (a row never gives to itself: it lacks
what it asks for).  Of the donors of a block that agree in every column that the asking
rows have, only the first k can be among the nearest.

Cases: a column without any value stays null; rows that share no column with a
donor do not use it, and with no donor at all the column's mean is taken; NaN is
a missing value; rows may repeat.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.components import materialize
from statloom.functions.exprs import clean_numeric, num, numeric_columns
from statloom.session import ensure_checkpoint_dir

NEIGHBOURS = 5
#: Most grid columns, most cells, rows of a cell aimed at, rows of a block and of an asking group.
GRID_COLUMNS = 3
MAX_CELLS = 4_096
CELL_ROWS = 1_000
BLOCK = 4_096
#: Donors that the first cells must hold, as a multiple of k.
FIRST = 4


def gaps_squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared missing-aware distances, rows of x by rows of y; infinite without a common column."""
    d = x.shape[1]
    total, common = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)))
    for j in range(d):
        gap = x[:, j, None] - y[None, :, j]
        both = ~np.isnan(gap)
        total += np.where(both, gap * gap, 0.0)
        common += both
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, total * d / common, np.inf)


class Cells:
    """Bounds of the cells: lowest and highest value of each column, rows that have it, blocks."""

    def __init__(self, rows, cols: list[str], block: int):
        self.no = np.array([r["cell"] for r in rows], np.int64)
        n = np.array([r["n"] for r in rows], np.int64)
        self.blocks = -(-n // block)
        at = lambda k: np.array([[r[f"{k}{j}"] if r[f"{k}{j}"] is not None else np.nan for j in range(len(cols))]
                                 for r in rows], np.float64).reshape(len(rows), len(cols))
        self.low, self.high, self.has = at("l"), at("h"), at("c")
        self.whole = self.has == n[:, None]  # no gaps in the column

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """Least squared distance of each row of x to any row of each cell."""
        total = np.zeros((len(x), len(self.no)))
        for j in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, j] - x[:, j, None], x[:, j, None] - self.high[:, j]), 0.0)
            total += np.where(~np.isnan(x[:, j, None]) & self.whole[:, j], gap * gap, 0.0)
        m = np.maximum((~np.isnan(x)).sum(1), 1)
        return total * (x.shape[1] / m[:, None]) * (1 - 1e-12)

    def first(self, x: np.ndarray, k: int) -> np.ndarray:
        """Which cells, nearest first, each row of x needs until every missing column has enough donors."""
        b = self.bounds(x)
        order = np.argsort(b, axis=1, kind="stable")
        stop = np.zeros(len(x), np.int64)
        for j in range(x.shape[1]):
            held = np.minimum(np.cumsum(self.has[:, j][order], axis=1), FIRST * k)
            stop = np.maximum(stop, np.where(np.isnan(x[:, j]), (held == held[:, -1:]).argmax(1) + 1, 0))
        wanted = np.zeros(b.shape, bool)
        np.put_along_axis(wanted, order, np.arange(b.shape[1]) < stop[:, None], axis=1)
        return wanted

    def within(self, x: np.ndarray, bars: np.ndarray) -> np.ndarray:
        """Which cells may hold a donor not farther than the bar of a missing column."""
        b = self.bounds(x)
        wanted = np.zeros(b.shape, bool)
        for j in range(x.shape[1]):
            wanted |= np.isnan(x[:, j, None]) & (b <= bars[:, j, None]) & (self.has[:, j] > 0)
        return wanted


def _first_of_equal(v: np.ndarray, k: int) -> np.ndarray:
    """The first k rows of every set of equal rows (missing values equal too), in the rows' order."""
    if not len(v):
        return np.zeros(0, np.int64)
    known = ~np.isnan(v)
    which = np.unique(np.hstack([np.where(known, v, 0.0), known]), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(which, kind="stable")
    starts = np.r_[0, np.flatnonzero(np.diff(which[order])) + 1]
    nth = np.arange(len(v)) - np.repeat(starts, np.diff(np.r_[starts, len(v)]))
    return np.sort(order[nth < k])


def _smallest(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k smallest finite numbers of every row, ties to the first."""
    fit = np.isfinite(d2)
    if d2.shape[1] > k:
        bar = np.partition(d2, k - 1, axis=1)[:, k - 1:k]
        less, tied = d2 < bar, d2 == bar
        room = k - less.sum(1, keepdims=True)
        fit &= less | (tied & (np.cumsum(tied, axis=1) <= room))
    return np.nonzero(fit)


def _grid(rows: DataFrame, cols: list[str], n: int, counts: dict[str, int], max_cells: int, cell_rows: int):
    """Cell number of a row as an expression: quantile bins of the fullest columns, bin 0 for a gap."""
    used = sorted(cols, key=lambda c: (-counts[c], cols.index(c)))[:GRID_COLUMNS]
    target = min(max_cells, max(1, n // cell_rows))
    per = max(1, int(round(target ** (1 / len(used)))))
    while per > 1 and (per + 1) ** len(used) > max_cells:
        per -= 1
    cell = F.lit(0)
    if per > 1:
        probs = [i / per for i in range(1, per)]
        cuts = rows.agg(*[F.percentile_approx(c, probs, 10_000).alias(c) for c in used]).first()
        for c in used:
            edges = sorted(set(cuts[c] or []))
            place = F.lit(1)
            for e in edges:
                place = place + (F.col(c) > F.lit(e)).cast("int")
            cell = cell * (per + 1) + F.coalesce(place, F.lit(0))
    return cell.cast("int")


def nearest_values(df: DataFrame, cols: list[str], k: int = NEIGHBOURS, key: str | None = None, max_cells: int = MAX_CELLS,
                   cell_rows: int = CELL_ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The rows with a number ``_row`` (``key`` where given) and ``(_row, column_name, imputed)`` of the gaps that have donors."""
    ensure_checkpoint_dir(df.sparkSession)
    number = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    rows = df.withColumn("_row", number).checkpoint(eager=True)
    x = clean_numeric(rows, cols, keep=["_row"])
    stats = x.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c{j}") for j, c in enumerate(cols)]).first()
    counts = {c: stats[f"c{j}"] for j, c in enumerate(cols)}
    placed = x.withColumn("cell", _grid(x, cols, stats.n, counts, max_cells, cell_rows)).checkpoint(eager=True)
    bounds = placed.groupBy("cell").agg(F.count("*").alias("n"), *[a for j, c in enumerate(cols) for a in (
        F.min(c).alias(f"l{j}"), F.max(c).alias(f"h{j}"), F.count(c).alias(f"c{j}"))])
    cells = Cells(sorted(bounds.collect(), key=lambda r: r["cell"]), cols, block)  # at most max_cells rows
    held = df.sparkSession.sparkContext.broadcast(cells)
    gaps = " OR ".join(f"`{c}` IS NULL" for c in cols)
    asking = materialize(placed.where(gaps).groupBy(*cols).agg(F.count("*").alias("_n")).drop("_n")
                         .withColumn("_ask", F.monotonically_increasing_id()))
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-asking.count() // block))
    d = len(cols)
    bar_cols = [f"b{j}" for j in range(d)]

    def ask(first: bool):
        def run(parts):
            c = held.value
            for pdf in parts:
                v, bars = pdf[cols].to_numpy(np.float64), None if first else pdf[bar_cols].to_numpy(np.float64)
                for s in range(0, len(v), 256):
                    x = v[s:s + 256]
                    at, cell = np.nonzero(c.first(x, k) if first else c.within(x, bars[s:s + 256]))
                    times = c.blocks[cell]
                    blk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    yield pdf.iloc[s + np.repeat(at, times)].assign(cell=np.repeat(c.no[cell], times), blk=blk)
        return run

    number_of = F.broadcast(df.sparkSession.createDataFrame(
        [(int(c), int(b)) for c, b in zip(cells.no, cells.blocks)], "cell int, blks int"))
    units = placed.join(number_of, "cell").withColumn("blk", F.pmod(F.xxhash64("_row"), F.col("blks")).cast("int")).drop("blks")

    def meet(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(e):
            e = e.sort_values("_row", kind="stable")
            a, b, donor, asks = q[cols].to_numpy(np.float64), e[cols].to_numpy(np.float64), e["_row"].to_numpy(), q["_ask"].to_numpy()
            bars = q[bar_cols].to_numpy(np.float64) if "b0" in q else np.full(a.shape, np.inf)
            kinds, kind = np.unique(np.isnan(a), axis=0, return_inverse=True)
            for i, gone in enumerate(kinds):
                mine = np.flatnonzero(kind.ravel() == i)
                for j in np.flatnonzero(gone):
                    able = np.flatnonzero(~np.isnan(b[:, j]))
                    able = able[_first_of_equal(b[able][:, ~gone], k)]
                    for s in range(0, len(mine), 256):
                        rows_at = mine[s:s + 256]
                        d2 = gaps_squared(a[rows_at], b[able])
                        d2[d2 > bars[rows_at, j, None]] = np.inf
                        r, at = _smallest(d2, k)
                        out.append(pd.DataFrame({"_ask": asks[rows_at[r]], "j": j, "d2": d2[r, at], "donor": donor[able[at]],
                                                 "value": b[able[at], j]}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["_ask", "j", "d2", "donor", "value"])

    def round_of(frame: DataFrame, first: bool) -> DataFrame:
        kinds = ", ".join(f"`{n}` {t}" for n, t in frame.dtypes)
        spread = frame.repartition(tasks, "_ask")
        wanted = materialize(spread.mapInPandas(ask(first), f"{kinds}, cell int, blk int"))
        parts = F.broadcast(materialize(wanted.groupBy("cell", "blk").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))))
        wanted = wanted.join(parts, ["cell", "blk"]).withColumn("part", F.pmod(F.xxhash64("_ask"), F.col("parts")).cast("int"))
        giving = units.join(parts, ["cell", "blk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["cell", "blk", "part"]
        return wanted.drop("parts").groupBy(*keys).cogroup(giving.drop("parts").groupBy(*keys)).applyInPandas(
            meet, "_ask long, j int, d2 double, donor long, value double")

    def best(found: DataFrame, of: str) -> DataFrame:
        w = Window.partitionBy(of, "j").orderBy("d2", "donor")
        return found.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).drop("nth")

    near = best(round_of(asking, True), "_ask")
    bar = near.groupBy("_ask", "j").agg(F.count("*").alias("c"), F.max("d2").alias("d2")).where(F.col("c") >= k)
    bars = bar.groupBy("_ask").agg(*[F.max(F.when(F.col("j") == j, F.col("d2"))).alias(b) for j, b in enumerate(bar_cols)])
    known = materialize(asking.join(bars, "_ask", "left").fillna(math.inf, bar_cols))
    # the cells within the bars include the first ones that matter
    found = best(round_of(known, False), "_ask")
    same = [placed[c].eqNullSafe(asking[c]) for c in cols]
    askers = placed.where(gaps).join(asking, same).select("_row", "_ask")
    found = best(askers.join(found, "_ask").drop("_ask"), "_row")  # rows that share a number share their donors
    names = F.array(*[F.lit(c) for c in cols])
    imputed = found.groupBy("_row", "j").agg(
        F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("d2", "donor", "value"))), lambda s: s["value"]),
                    F.lit(0.0), lambda a, v: a + v).alias("s"), F.count("*").alias("c"))
    return rows, imputed.select("_row", F.get(names, F.col("j")).alias("column_name"), (F.col("s") / F.col("c")).alias("imputed"))


def knn_impute(df: DataFrame, cols: list[str] | None = None, k: int = NEIGHBOURS, key: str | None = None, **options) -> DataFrame:
    """``df`` with the gaps of the numeric ``cols`` filled (as doubles); ``key``: a unique whole-number column for ties."""
    cols = cols or [c for c in numeric_columns(df) if c != key]
    rows, values = nearest_values(df, cols, k, key, **options)
    means = clean_numeric(df, cols).agg(*[F.avg(c).alias(c) for c in cols]).first()
    wide = values.groupBy("_row").agg(*[F.max(F.when(F.col("column_name") == c, F.col("imputed"))).alias(f"_i{j}")
                                        for j, c in enumerate(cols)])
    x = rows.withColumns({c: num(c) for c in cols})
    out = x.join(wide, "_row", "left")
    filled = {c: F.coalesce(F.col(c), F.col(f"_i{j}"), F.lit(means[c]).cast("double")) for j, c in enumerate(cols)}
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
