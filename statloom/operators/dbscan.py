"""DBSCAN (M5), Ester et al. (1996), on an eps-grid.

Points are standardised (population std) complete cases.  Identical vectors
collapse to one weighted point first, so a value repeated by a third of the
rows costs one row.  The grid side is ``eps / sqrt(d)``: any two points of one
cell are within ``eps``, so

* a cell holding ``min_samples`` points makes all of them core with no
  distance test, and all core points of a cell share one cluster;
* the neighbours of a cell are the occupied cells whose boxes lie within
  ``eps``; they are found by a join on a coarser grid over at most three
  columns, whatever the number of columns;
* a neighbour cell lying entirely inside a point's eps-ball (farthest corner
  within ``eps``) is counted, or gives its label, without distance tests, and
  two core cells whose farthest corners are within ``eps`` are linked without
  tests;
* elsewhere points meet the blocks of the neighbour cell in numpy and return one row
  each (a count, or whether a core point is near); of two core cells only the points
  within ``eps`` of the other cell's bounds meet, and the first pair found ends
  the search.  Pairs of points are never rows;
* clusters are connected components of the *cell* graph whose edges join
  cells with a pair of core points within ``eps``; alternating star rounds
  contract it until nothing changes (``functions.components``).

With more columns than the coarse grid has and hardly two points a cell, cells
spare nothing: boxes near each other are most pairs of cells.  There the points are cut
into units (quantile bins of a few columns, cut by hash where large), and the pairs
of units whose boxes lie within ``eps`` meet in numpy, a task each: once to count
the neighbours, once to link the core points (a unit's own first, so that
units link components and not points) and once to label the border.

Border points join the smallest label among their core neighbours; the rest
is noise (label -1).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.components import connected_components, materialize
from statloom.functions.exprs import numeric_columns
from statloom.operators.prepare import complete_cases, standardize
from statloom.session import ensure_checkpoint_dir

EPS = 0.5
MIN_SAMPLES = 5
#: Columns of the coarser grid, and points of a block that meet in one task.
GRID_COLUMNS = 3
BLOCK = 4_096
#: Units aimed at, and the least and most points aimed at in one.
UNITS = 32
UNIT_ROWS = (1_024, 16_384)


def _sum_of_squares(zipped, f):
    return F.aggregate(F.transform(zipped, f), F.lit(0.0), lambda s, v: s + v * v)


def _cell_pairs(cells: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """``(cell, ncell, n, far2)``: occupied cells whose boxes lie within eps (the cell itself too), with the
    neighbour's weight and the squared distance of the farthest corners."""
    g = min(d, GRID_COLUMNS)
    # middles of two such cells are less than eps + side apart in every column
    coarse = cells.withColumn("k", F.transform(F.slice("cell", 1, g), lambda c: F.floor((c + 0.5) * F.lit(side / (eps + side)))))
    around = F.array(*[F.array(*[F.element_at("k", i + 1) + F.lit(o) for i, o in enumerate(step)])
                       for step in itertools.product((-1, 0, 1), repeat=g)])
    left = coarse.select("cell", F.explode(around).alias("k"))
    right = coarse.select(F.col("cell").alias("ncell"), F.col("cell_n").alias("n"), "k")
    gaps = F.arrays_zip("cell", "ncell")
    near2 = _sum_of_squares(gaps, lambda t: F.greatest(F.abs(t["cell"] - t["ncell"]) - 1, F.lit(0)) * F.lit(side))
    far2 = _sum_of_squares(gaps, lambda t: (F.abs(t["cell"] - t["ncell"]) + 1) * F.lit(side))
    return left.join(right, "k").where(near2 <= eps * eps * (1 + 1e-9)).select("cell", "ncell", "n", far2.alias("far2"))


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _within(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of x and y are within eps, columns added in order."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        total += (x[:, j, None] - y[None, :, j]) ** 2
    return total <= eps * eps


def _meet(asking: DataFrame, pts: DataFrame, sizes: DataFrame, eps: float, block: int, schema: str, answer) -> DataFrame:
    """``answer(asking rows, block rows, near)`` for the asking rows (ncell, x, ...) and each block of their cell's points.

    ``near(i)`` tells which block rows lie within eps of the asking rows ``i``.
    """
    blocks = sizes.select(F.col("cell").alias("ncell"), F.ceil(F.col("rows") / block).cast("int").alias("blks"))
    wanted = asking.join(blocks, "ncell").withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blks") - 1))).drop("blks")
    wanted = wanted.withColumn("part", F.pmod(F.xxhash64("x"), F.lit(1 << 20)))  # many askers of one block go to several tasks
    parts = wanted.groupBy("ncell", "blk").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    wanted = wanted.join(parts, ["ncell", "blk"]).withColumn("part", (F.col("part") % F.col("parts")).cast("int")).drop("parts")
    held = pts.withColumnRenamed("cell", "ncell").join(blocks, "ncell").withColumn(
        "blk", F.pmod(F.xxhash64("x"), F.col("blks")).cast("int")).drop("blks")
    held = held.join(parts, ["ncell", "blk"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    held = held.toDF(*held.columns)  # columns of its own: both sides come from the same points
    keys = ["ncell", "blk", "part"]

    def run(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(q) or not len(e):
            return pd.DataFrame([], columns=names)
        x, y = _stack(q["x"]), _stack(e["x"])
        return pd.DataFrame(answer(q, e, lambda i: _within(x[i], y, eps)), columns=names)

    return wanted.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, schema)


def _slices(n: int, size: int = 512):
    return (slice(s, s + size) for s in range(0, n, size))


def _close(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """As :func:`_within`, by a matrix product; only pairs at eps but for its rounding are added up column by column."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    d2 = x @ (-2.0 * y.T)
    d2 += xx[:, None]
    d2 += yy
    slack = 1e-12 * (xx.max(initial=0.0) + yy.max(initial=0.0) + eps * eps)
    near = d2 <= eps * eps + slack
    sure = d2 <= eps * eps - slack
    i, j = np.nonzero(near & ~sure)
    total = np.zeros(len(i))
    for c in range(x.shape[1]):
        total += (x[i, c] - y[j, c]) ** 2
    near[i, j] = total <= eps * eps
    return near


def _own_components(x: np.ndarray, eps: float) -> np.ndarray:
    """Number of the component of every row, by the first row in it."""
    part = np.full(len(x), -1)
    left = np.arange(len(x))
    while len(left):
        first = left[0]
        part[first] = first
        left, wave = left[1:], np.array([first])
        while len(wave) and len(left):
            hit = np.zeros(len(left), bool)
            for i in _slices(len(wave)):
                rest = np.flatnonzero(~hit)
                hit[rest] = _close(x[wave[i]], x[left[rest]], eps).any(0)
            wave, left = left[hit], left[~hit]
            part[wave] = first
    return part


def _linked_parts(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """The pairs of parts (a of x's rows, b of y's) with two rows within eps."""
    order = np.argsort(b, kind="stable")
    y, b = y[order], b[order]
    starts = np.r_[0, np.flatnonzero(np.diff(b)) + 1]
    out = []
    for i in _slices(len(x)):
        r, c = np.nonzero(np.logical_or.reduceat(_close(x[i], y, eps), starts, axis=1))
        out.append(np.unique(np.stack([a[i][r], b[starts[c]]], 1), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def _units(pts: DataFrame, d: int, n: int) -> DataFrame:
    """The points with the number ``u`` of their unit."""
    rows = min(max(n // UNITS, UNIT_ROWS[0]), UNIT_ROWS[1])
    wanted = -(-n // rows)
    used = max(1, min(GRID_COLUMNS, d, int(math.log(wanted, 8))))
    per = max(1, round(wanted ** (1 / used)))
    tile = F.lit(0)
    if per > 1:
        probs = [i / per for i in range(1, per)]
        cuts = pts.agg(*[F.percentile_approx(f"x{j}", probs, 1_000).alias(f"c{j}") for j in range(used)]).first()
        for j in range(used):
            at = F.lit(0)
            for e in sorted(set(cuts[f"c{j}"])):
                at = at + (F.col(f"x{j}") > F.lit(e)).cast("int")
            tile = tile * per + at
    pts = pts.withColumn("tile", tile)
    cut = pts.groupBy("tile").agg(F.ceil(F.count("*") / (2 * rows)).alias("blks"))
    return pts.join(F.broadcast(cut), "tile").withColumn(
        "u", F.col("tile").cast("long") * (1 << 20) + F.pmod(F.xxhash64("pid"), F.col("blks"))).drop("tile", "blks")


def _labels_by_units(pts: DataFrame, cells: DataFrame, n: int, d: int, eps: float, min_samples: int) -> DataFrame:
    """``(x, w, core, label)`` of the points: every two units near each other meet, see the module's head."""
    xs = [f"x{j}" for j in range(d)]
    pts = pts.join(cells.select("cell", "cell_n"), "cell").select(
        "pid", "w", "cell_n", *[F.get("x", F.lit(j)).alias(c) for j, c in enumerate(xs)])
    pts = materialize(_units(pts, d, n))
    box = pts.groupBy("u").agg(*[f(c).alias(f"{k}{c}") for c in xs for k, f in (("l", F.min), ("h", F.max))])
    box = materialize(box)
    other = box.toDF("v", *[f"o{c}" for c in box.columns[1:]])
    gap2 = sum((F.pow(F.greatest(F.col(f"l{c}") - F.col(f"oh{c}"), F.col(f"ol{c}") - F.col(f"h{c}"), F.lit(0.0)), 2) for c in xs), F.lit(0.0))
    pairs = materialize(box.crossJoin(other).where(gap2 <= eps * eps * (1 + 1e-9)).select("u", "v"))

    def met(asking: DataFrame, held: DataFrame, of: DataFrame, schema: str, answer) -> DataFrame:
        of = F.broadcast(of)
        held = held.withColumnRenamed("u", "v").join(of, "v")
        held = held.toDF(*held.columns)  # columns of its own: both sides come from the same points
        names = [c.split()[0] for c in schema.split(", ")]

        def run(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(e):
                return pd.DataFrame([], columns=names)
            return pd.DataFrame(dict(zip(names, answer(q, q[xs].to_numpy(np.float64), e, e[xs].to_numpy(np.float64)))))

        return asking.join(of, "u").groupBy("u", "v").cogroup(held.groupBy("u", "v")).applyInPandas(run, schema)

    def count(q, x, e, y):
        w = e["w"].to_numpy(np.float64)
        found = np.concatenate([_close(x[i], y, eps) @ w for i in _slices(len(x))])
        return q["pid"].to_numpy()[found > 0], found[found > 0].astype(np.int64)

    degree = met(pts.where(F.col("cell_n") < min_samples).select("u", "pid", *xs), pts.select("u", "w", *xs), pairs,
                 "pid long, n long", count).groupBy("pid").agg(F.sum("n").alias("degree"))
    core = materialize(pts.join(degree, "pid", "left").withColumn(
        "core", (F.col("cell_n") >= min_samples) | (F.coalesce("degree", F.lit(0)) >= min_samples)).drop("degree", "cell_n"))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        pid = pdf["pid"].to_numpy()
        return pdf.assign(part=pid[_own_components(pdf[xs].to_numpy(np.float64), eps)])

    columns = ", ".join(f"{c} double" for c in xs)
    cores = materialize(core.where("core").select("u", "pid", *xs).groupBy("u").applyInPandas(
        own, f"u long, pid long, {columns}, part long"))

    def link(q, x, e, y):
        return _linked_parts(x, q["part"].to_numpy(), y, e["part"].to_numpy(), eps).T

    edges = met(cores.drop("pid"), cores.drop("pid"), pairs.where("u < v"), "a long, b long", link)
    comp = connected_components(edges).toDF("part", "label")
    cores = materialize(cores.join(comp, "part", "left").select("u", "pid", *xs, F.coalesce("label", "part").alias("label")))

    def touched(q, x, e, y):
        label = e["label"].to_numpy()
        none = np.iinfo(np.int64).max
        found = np.concatenate([np.where(_close(x[i], y, eps), label, none).min(1) for i in _slices(len(x))])
        return q["pid"].to_numpy()[found < none], found[found < none]

    border = met(core.where(~F.col("core")).select("u", "pid", *xs), cores.drop("pid"), pairs, "pid long, label long", touched)
    of = cores.select("pid", "label").unionByName(border.groupBy("pid").agg(F.min("label").alias("label")))
    return core.join(of, "pid", "left").select(F.array(*xs).alias("x"), "w", "core", F.coalesce("label", F.lit(-1)).alias("label"))


def dbscan_labels(df: DataFrame, cols: list[str] | None = None, eps: float = EPS,
                  min_samples: int = MIN_SAMPLES, block: int = BLOCK) -> DataFrame:
    """``(vector columns..., w, core, label)`` per distinct standardised vector."""
    cols = cols or numeric_columns(df)
    ensure_checkpoint_dir(df.sparkSession)
    d = len(cols)
    side = eps / math.sqrt(d) * (1 - 1e-12)
    z = standardize(complete_cases(df.select(*cols), cols), cols)
    pts = z.groupBy(*cols).agg(F.count(F.lit(1)).alias("w"))
    pts = pts.select(F.array(*cols).alias("x"), "w", F.array(*[F.floor(F.col(c) / side) for c in cols]).alias("cell"))
    pts = pts.withColumn("pid", F.monotonically_increasing_id()).checkpoint(eager=True)
    cells = pts.groupBy("cell").agg(F.sum("w").alias("cell_n"), F.count("*").alias("rows")).checkpoint(eager=True)
    n = pts.count()
    if d > GRID_COLUMNS and 2 * cells.count() > n:
        found = _labels_by_units(pts, cells, n, d, eps, min_samples)
        return found.select(*[F.get("x", F.lit(j)).alias(c) for j, c in enumerate(cols)], "w", "core", "label")
    near = _cell_pairs(cells, d, side, eps).checkpoint(eager=True)
    p = pts.join(cells.drop("rows"), "cell")

    def neighbours(frame, table):
        """The neighbour cells of points, and whether all of a cell lies in the point's eps-ball."""
        far2 = _sum_of_squares(F.arrays_zip("x", "ncell"), lambda t: F.greatest(
            F.abs(t["x"] - t["ncell"] * side), F.abs(t["x"] - (t["ncell"] + 1) * side)))
        close2 = _sum_of_squares(F.arrays_zip("x", "ncell"), lambda t: F.greatest(
            t["ncell"] * side - t["x"], t["x"] - (t["ncell"] + 1) * side, F.lit(0.0)))
        out = frame.join(table, "cell").where(close2 <= eps * eps * (1 + 1e-9))
        return out.withColumn("whole", far2 <= eps * eps * (1 - 1e-9))

    # degree of points in sparse cells
    nb = neighbours(p.where(F.col("cell_n") < min_samples).select("pid", "x", "cell"), near).checkpoint(eager=True)
    whole = nb.where("whole").groupBy("pid").agg(F.sum("n").alias("n"))

    def count(q, e, close):
        w = e["w"].to_numpy()
        return [(pid, int(n)) for i in _slices(len(q)) for pid, n in zip(q["pid"].iloc[i], close(i) @ w)]

    counted = _meet(nb.where("NOT whole").select("ncell", "pid", "x"), pts.select("cell", "x", "w"), cells, eps, block,
                    "pid long, n long", count)
    degree = whole.unionByName(counted).groupBy("pid").agg(F.sum("n").alias("degree"))
    core = (p.join(degree, "pid", "left")
            .withColumn("core", (F.col("cell_n") >= min_samples) | (F.coalesce("degree", F.lit(0)) >= min_samples))
            .drop("degree", "cell_n").checkpoint(eager=True))
    cores = core.where("core").select("cell", "x", "pid")
    bound = lambda f: F.array(*[f(F.get("x", F.lit(j))) for j in range(d)])
    ccells = cores.groupBy("cell").agg(F.count("*").alias("rows"), bound(F.min).alias("low"), bound(F.max).alias("high")
                                       ).checkpoint(eager=True)
    # links of core cells: by their corners, else by their points
    links = near.where("cell < ncell").join(ccells.select("cell"), "cell").join(
        ccells.select(F.col("cell").alias("ncell"), "low", "high"), "ncell")
    sure = links.where(F.col("far2") <= eps * eps * (1 - 1e-9)).select("cell", "ncell")
    gap2 = _sum_of_squares(F.arrays_zip("x", "low", "high"), lambda t: F.greatest(t["low"] - t["x"], t["x"] - t["high"], F.lit(0.0)))
    facing = cores.join(links.where(F.col("far2") > eps * eps * (1 - 1e-9)).select("cell", "ncell", "low", "high"), "cell")
    facing = facing.where(gap2 <= eps * eps * (1 + 1e-9)).select("cell", "ncell", "x")

    def linked(q, e, close):
        out = []
        for cell, own in q.reset_index(drop=True).groupby(q["cell"].map(tuple).to_numpy()):
            at = own.index.to_numpy()
            if any(close(at[i]).any() for i in _slices(len(at))):
                out.append((list(cell), e["ncell"].iloc[0]))
        return out

    tested = _meet(facing, cores.select("cell", "x"), ccells, eps, block, "cell array<bigint>, ncell array<bigint>", linked)
    cell_ids = ccells.select("cell", F.monotonically_increasing_id().alias("node")).checkpoint(eager=True)
    edges = sure.unionByName(tested).distinct().join(cell_ids.withColumnRenamed("node", "a"), "cell").join(
        cell_ids.toDF("ncell", "b"), "ncell").select("a", "b")
    comp = connected_components(edges).toDF("_n", "component")
    labels = cell_ids.join(comp, F.col("node") == F.col("_n"), "left").select("cell", F.coalesce("component", "node").alias("label"))
    labels = labels.checkpoint(eager=True)
    # border points
    at_core = near.join(labels.select(F.col("cell").alias("ncell"), "label"), "ncell")
    bn = neighbours(core.where(~F.col("core")).select("pid", "x", "cell"), at_core).checkpoint(eager=True)

    def touched(q, e, close):
        hit = np.concatenate([close(i).any(1) for i in _slices(len(q))])
        return list(zip(q["pid"][hit], q["label"][hit]))

    border = _meet(bn.where("NOT whole").select("ncell", "pid", "x", "label"), cores.select("cell", "x"), ccells, eps, block,
                   "pid long, label long", touched)
    border = bn.where("whole").select("pid", "label").unionByName(border).groupBy("pid").agg(F.min("label").alias("label"))
    of = cores.join(labels, "cell").select("pid", "label").unionByName(border)
    return core.join(of, "pid", "left").select(*[F.get("x", F.lit(j)).alias(c) for j, c in enumerate(cols)], "w", "core",
                                               F.coalesce("label", F.lit(-1)).alias("label"))


def dbscan_summary(df: DataFrame, cols: list[str] | None = None, eps: float = EPS,
                   min_samples: int = MIN_SAMPLES) -> dict[str, DataFrame]:
    """``summary``: clusters, noise and core points; ``sizes``: rows per cluster."""
    lab = dbscan_labels(df, cols, eps, min_samples).checkpoint(eager=True)
    clustered = lab.filter(F.col("label") != -1)
    sizes = clustered.groupBy("label").agg(F.sum("w").alias("size"))
    summary = lab.agg(
        F.countDistinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("label") == -1, F.col("w"))), F.lit(0)).cast("long").alias("n_noise"),
        F.coalesce(F.sum(F.when(F.col("core"), F.col("w"))), F.lit(0)).cast("long").alias("n_core"))
    ranked = sizes.select(F.col("size").cast("long").alias("size"))
    return {"summary": summary, "sizes": ranked}
