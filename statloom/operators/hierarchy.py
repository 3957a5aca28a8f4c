"""Hierarchical clustering by single linkage: a minimum spanning forest grown by levels of distance.

Single linkage merges along the minimum spanning tree of the points, so its merge
heights are the tree's edges.  Equal points are one point first (their merges have
height 0).  Then edges are found by level, R, 2R, 4R, ..., up to the
whole table:

* Level 0.  Points fall into cells of side 4R; a cell's task also holds the points
  within R of it, and finds the minimum spanning forest of the edges up to R it
  sees (the forest of a union of edge sets lies in the union of their forests).  R is
  the largest that leaves no cell with more than ``CELL`` points.  An edge is surely the
  tree's if it is the shortest one out of a component that no point beyond the task's
  reach can be nearer to.  Points of a cell joined by sure edges are one node from there
  on, so only the edges along the borders of cells meet in the rounds below.
* Level l.  Points closer than the last radius are one component by now, so a cell whose
  diagonal is the last radius lies in one component: components are columns of a
  table of occupied cells, not of points.  Occupied cells that are near each other meet
  by a join on coarser cells; pairs of different components whose boxes lie within the
  new radius (twice the last), and no farther than another pair of the same two components surely is,
  remain.  Cells of more than ``BLOCK`` points are halved until they hold fewer or drop out, and only the
  points of what remains are compared, along the widest column.
* The shortest edge between two components is all a level needs.  Boruvka rounds (every
  component takes its shortest edge; components by alternating stars) pick the tree's
  edges; where a proven small number of edges is left, one task takes them all.

Equally long edges are taken in the order of their ends' ids, so that all tasks grow the same tree.

Cases: rows with a missing value take no part; one row or none has no merges; ties
at equal heights may be taken in any order, the heights are the same.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.components import connected_components, materialize
from statloom.functions.exprs import clean_numeric, numeric_columns
from statloom.operators.prepare import complete_cases, standardize
from statloom.session import ensure_checkpoint_dir

#: Points of a cell at level 0 and of a block at later levels.
CELL = 400
BLOCK = 2_048
#: Columns that the joins of cells are made on.
GRID_COLUMNS = 3
#: Edges that one task may hold instead of Boruvka rounds.
ONE_TASK = 200_000
#: How often a level's crowded cells are cut smaller at most; what is crowded then is compared in blocks.
HALVINGS = 10
#: Occupied cells among which the radius grows eightfold instead of twofold.
FEW_CELLS = 500
LAST = 30


def spanning_forest(dist: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the minimum spanning forest of a matrix of distances (inf: no edge), by Prim's algorithm.

    Of equally long edges that with the smaller lower end counts as shorter, then that with the smaller upper end.
    """
    n = len(dist)
    every = np.arange(n)
    left = np.ones(n, bool)
    best, by, key = np.full(n, np.inf), np.full(n, -1), np.zeros(n, np.int64)
    out = []
    for _ in range(n):
        at = int(best.argmin())
        if best[at] < np.inf:
            ties = np.flatnonzero(best == best[at])
            if len(ties) > 1:
                at = int(ties[key[ties].argmin()])
            out.append((int(by[at]), at))
        else:
            at = int(left.argmax())  # another tree begins
        left[at] = False
        best[at] = np.inf
        d = dist[at]
        closer = (d < best) & left
        edge = np.where(every < at, every * n + at, at * n + every)
        closer |= (d == best) & (edge < key) & left
        best[closer], by[closer], key[closer] = d[closer], at, edge[closer]
    return out


def _find(up, v):
    while up[v] != v:
        up[v] = up[up[v]]
        v = up[v]
    return v


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def _flat(cols: int) -> list:
    """The array column ``x`` as columns, which reach a task without an object a row."""
    return [F.get("x", F.lit(j)).alias(f"x{j}") for j in range(cols)]


def _matrix(pdf: pd.DataFrame, cols: int) -> np.ndarray:
    return np.column_stack([pdf[f"x{j}"].to_numpy() for j in range(cols)])


def _cell(x, side: float, dims: int | None = None):
    """Grid coordinates of an array column."""
    return F.transform(F.slice(x, 1, dims) if dims else x, lambda v: F.floor(v / F.lit(side)).cast("long"))


def _near(cell, dims: int, half: bool = False):
    """The cells around a cell, itself included; with ``half``, one of each two opposite ones."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=dims) if not half or s >= (0,) * dims]
    return F.explode(F.array(*[F.array(*[F.element_at(cell, i + 1) + F.lit(k) for i, k in enumerate(s)]) for s in steps]))


def _first_radius(pts: DataFrame, dims: int, extent: float, most: int) -> float:
    """The largest radius, halving from the extent, at which no cell of side 4R holds more than ``most`` points."""
    side, tries = extent * 1.000001, 4
    while True:
        sides = [side / 2 ** t for t in range(tries)]
        cell = F.array(*[F.struct(F.lit(t).alias("t"), _cell(F.col("x"), s, dims).alias("c")) for t, s in enumerate(sides)])
        got = pts.select(F.inline(cell)).groupBy("t", "c").count().groupBy("t").agg(F.max("count").alias("n")).collect()
        fit = [r.t for r in got if r.n <= most]
        if fit:
            return sides[min(fit)] / 4
        side = sides[-1] / 2
        if side < extent * 1e-12:
            return side / 4


def _level_0(pts: DataFrame, cols: int, dims: int, radius: float) -> DataFrame:
    """a, b, d, rep: the edges up to ``radius`` that may be the tree's, each from the cell of its end ``a``.

    Edges with ``rep`` are surely the tree's and lie in one cell; ``rep`` is the smallest of the cell's points
    that such edges join, and rows without ``d`` give it (``b``) for every point (``a``).  Other edges have ``rep`` -1.
    """
    side = 4 * radius
    homes = pts.select("pid", "x", _cell(F.col("x"), side, dims).alias("home"))
    each = homes.withColumn("cell", _near(F.col("home"), dims))
    gap = F.aggregate(F.transform(F.arrays_zip("cell", F.slice("x", 1, dims).alias("v")), lambda t: F.pow(F.greatest(
        t["cell"] * side - t["v"], t["v"] - (t["cell"] + 1) * side, F.lit(0.0)), 2)), F.lit(0.0), lambda s, v: s + v)
    each = each.withColumn("gap", gap).where(F.col("gap") <= radius * radius * (1 + 1e-9)).withColumn(
        "own", F.col("cell") == F.col("home"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["own"].any():
            return pd.DataFrame([], columns=["a", "b", "d", "rep"])
        pdf = pdf.sort_values("pid")
        x, pid, own = _matrix(pdf, cols), pdf["pid"].to_numpy(), pdf["own"].to_numpy()
        dist = _distances(x, x)
        edge = np.where(dist <= radius, dist, np.inf)
        np.fill_diagonal(edge, np.inf)
        # points that the task does not hold are farther from a point than this
        reach = radius * (1 - 1e-6) - np.where(own, 0.0, np.sqrt(pdf["gap"].to_numpy()))
        comp, same = list(range(len(x))), list(range(len(x)))
        reach = reach.tolist()
        got = []
        for d, i, j in sorted((dist[i, j], min(i, j), max(i, j)) for i, j in spanning_forest(edge)):
            u, v = _find(comp, i), _find(comp, j)
            sure = d <= max(reach[u], reach[v])
            comp[v] = u
            reach[u] = min(reach[u], reach[v])
            inner = sure and own[i] and own[j]
            if inner:
                u, v = sorted((_find(same, i), _find(same, j)))
                same[v] = u
            if own[i]:
                got.append((i, j, d, inner))
        mine = np.flatnonzero(own)
        rep = pid[[_find(same, i) for i in mine.tolist()]]
        out = [pd.DataFrame({"a": pid[mine], "b": rep, "d": np.nan, "rep": rep})]
        if got:
            i, j, d, inner = (np.array(v) for v in zip(*got))
            group = np.array([_find(same, k) for k in i.tolist()])
            out.append(pd.DataFrame({"a": pid[i], "b": pid[j], "d": d, "rep": np.where(inner, pid[group], -1)}))
        return pd.concat(out)

    return each.select("pid", *_flat(cols), "own", "gap", "cell").groupBy("cell").applyInPandas(
        forest, "a long, b long, d double, rep long")


def _shortest(edges: DataFrame) -> DataFrame:
    """One edge a pair, a < b, with its points ``p`` and ``q``."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.min(F.struct("d", "p", "q")).alias("e")).select("a", "b", "e.*")


def _kruskal(pdf: pd.DataFrame) -> pd.DataFrame:
    """The forest's edges, and behind them every node with its component (without a length)."""
    up: dict[int, int] = {}
    kept = []
    for e in pdf.sort_values(["d", "a", "b"])[["a", "b", "d", "p", "q"]].itertuples(index=False):
        x, y = (_find(up, up.setdefault(v, v)) for v in (e.a, e.b))
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(tuple(e))
    kept += [(v, _find(up, v), None, v, v) for v in list(up)]
    return pd.DataFrame(kept, columns=["a", "b", "d", "p", "q"])


def _minimum_forest(edges: DataFrame, one_task: int) -> tuple[DataFrame, DataFrame]:
    """The minimum spanning forest (a, b, d) of the edges, its ends their points, and (node, component) of its nodes.

    ``edges``: nodes a, b, length d, and p, q, the points of the nodes that the edge joins.
    """
    left = materialize(_shortest(edges))
    columns = left.columns
    out = None

    def ends(found):
        return found.select(F.col("p").alias("a"), F.col("q").alias("b"), "d")

    while n := left.count():
        if n <= one_task:
            done = materialize(left.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
                _kruskal, "a long, b long, d double, p long, q long"))
            rest = done.where("d IS NOT NULL")
            if out is None:
                return ends(rest), done.where("d IS NULL").select(F.col("a").alias("node"), F.col("b").alias("component"))
            out = out.unionByName(rest)
            break
        both = left.withColumn("v", F.col("a")).unionByName(left.withColumn("v", F.col("b")))
        chosen = materialize(both.groupBy("v").agg(F.min(F.struct("d", "a", "b", "p", "q")).alias("e")).select("e.*")
                             .select(*columns).distinct())
        out = chosen if out is None else out.unionByName(chosen)
        comp = materialize(connected_components(chosen.select("a", "b")))
        for end in "ab":
            left = left.join(comp.toDF(end, f"_{end}"), end).drop(end).withColumnRenamed(f"_{end}", end)
        left = materialize(_shortest(left))
    if out is None:
        return ends(left), left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends(out), connected_components(out.select("a", "b"))


def _joined(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b, d) between points, led to their nodes (pid, node); the points stay as p and q."""
    out = links.select(F.col("a").alias("p"), F.col("b").alias("q"), "d")
    for end, point in (("a", "p"), ("b", "q")):
        out = out.join(nodes.toDF(point, end), point)
    return out.select("a", "b", "d", "p", "q")


def _labelled(nodes: DataFrame, column: str, components: DataFrame) -> DataFrame:
    """``nodes`` with ``column`` taken to its component."""
    out = nodes.join(components.toDF("_n", "_c"), F.col(column) == F.col("_n"), "left")
    return out.withColumn(column, F.coalesce("_c", column)).drop("_n", "_c")


def _boxes(low: str, high: str, cols: int) -> list:
    """Aggregates: the corners of the boxes around what a cell holds."""
    return [F.array(*[f(F.get(c, F.lit(j))) for j in range(cols)]).alias(name)
            for name, c, f in (("low", low, F.min), ("high", high, F.max))]


def _close(pairs: DataFrame, radius: float) -> DataFrame:
    """Pairs of cells whose boxes lie within the radius, and no farther than another pair of the components surely is."""
    def squared(name, f):
        z = F.transform(F.arrays_zip("ul", "uh", "vl", "vh"), f)
        return F.aggregate(z, F.lit(0.0), lambda s, t: s + t * t).alias(name)

    least = squared("least", lambda t: F.greatest(t["ul"] - t["vh"], t["vl"] - t["uh"], F.lit(0.0)))
    most = squared("most", lambda t: F.greatest(t["uh"] - t["vl"], t["vh"] - t["ul"]))
    pairs = pairs.select("u", "v", "a", "b", "un", "vn", least, most).where(F.col("least") <= radius ** 2 * (1 + 1e-9))
    # another pair of cells of the same components may be surely closer
    bar = pairs.groupBy("a", "b").agg(F.min("most").alias("bar"))
    return pairs.join(bar, ["a", "b"]).where(F.col("least") <= F.col("bar") * (1 + 1e-9)).drop("most", "bar")


def _closest(x: np.ndarray, y: np.ndarray) -> float:
    """The smallest distance between rows of ``x`` and of ``y``."""
    axis = int(np.argmax(np.maximum(x.max(0) - x.min(0), y.max(0) - y.min(0))))
    x, y = x[np.argsort(x[:, axis])], y[np.argsort(y[:, axis])]
    at = np.searchsorted(y[:, axis], x[:, axis])
    best = min(math.sqrt(sum((x[:, j] - y[k, j]) ** 2 for j in range(x.shape[1])).min())
               for k in (np.maximum(at - 1, 0), np.minimum(at, len(y) - 1)))
    # what the boxes are apart in the other columns is no part of the way along this one
    apart = np.delete(np.maximum(0.0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0))), axis)
    way = math.sqrt(max(0.0, best ** 2 * (1 + 1e-9) - (apart ** 2).sum() * (1 - 1e-9)))
    low = np.searchsorted(y[:, axis], x[:, axis] - way, "left")
    high = np.searchsorted(y[:, axis], x[:, axis] + way, "right")
    for s in range(0, len(x), 64):
        part = y[low[s]:high[min(s + 64, len(x)) - 1]]
        if len(part):
            best = min(best, _distances(x[s:s + 64], part).min())
    return best


def _compared(pairs: DataFrame, pts: DataFrame, cols: int, fine: float, block: int) -> DataFrame:
    """a, b, d: the shortest edge of every pair of cells."""
    pairs = pairs.withColumns({"ub": F.ceil(F.col("un") / block), "vb": F.ceil(F.col("vn") / block)})
    # two cells of one point each: their boxes are the points
    single = pairs.where("un + vn = 2").select("a", "b", F.sqrt("least").alias("d"))
    pairs = pairs.where("un + vn > 2").drop("un", "vn", "least")
    if pairs.isEmpty():
        return single
    pts = pts.select("x", _cell(F.col("x"), fine).alias("cell"), F.xxhash64("pid").alias("h"))
    one = pairs.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("vb").cast("int") - 1)))
    one = one.join(pts.withColumnRenamed("cell", "u"), "u").withColumn("i", F.pmod("h", "ub").cast("int"))
    other = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ub").cast("int") - 1)))
    other = other.join(pts.withColumnRenamed("cell", "v"), "v").withColumn("j", F.pmod("h", "vb").cast("int"))
    keys = ["u", "i", "j", "v", "a", "b"]

    def closest(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame([], columns=["a", "b", "d"])
        return pd.DataFrame({"a": [key[4]], "b": [key[5]], "d": [_closest(_matrix(p, cols), _matrix(q, cols))]})

    # columns of its own on the other side: both come from the same pairs
    other = other.select(*keys, *_flat(cols)).toDF(*keys, *[f"x{j}" for j in range(cols)])
    found = one.select(*keys, *_flat(cols)).groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(
        closest, "a long, b long, d double")
    return found.unionByName(single)


def _between(cells: DataFrame, pts: DataFrame, cols: int, dims: int, fine: float, radius: float, block: int) -> DataFrame:
    """a, b, d: shortest edges up to ``radius`` between components whose cells are near each other."""
    coarse = cells.withColumn("k", _cell(F.transform("cell", lambda v: (v + 0.5) * F.lit(fine)), radius, dims))
    # cell middles lie within the radius and a cell's breadth of each other, so at most two coarse cells apart
    steps = [s for s in itertools.product((-2, -1, 0, 1, 2), repeat=dims)]
    around = F.explode(F.array(*[F.array(*[F.element_at("k", i + 1) + F.lit(s) for i, s in enumerate(t)]) for t in steps]))

    def side(of, u, *more):
        return of.select(F.col("cell").alias(u), F.col("low").alias(f"{u}l"), F.col("high").alias(f"{u}h"), F.col("n").alias(f"{u}n"), *more)

    left = side(coarse, "u", F.col("comp").alias("a"), around.alias("k"))
    right = side(coarse, "v", F.col("comp").alias("b"), "k")
    pairs = materialize(_close(left.join(right, "k").where("a < b"), radius))
    found = None
    for halvings in range(HALVINGS + 1):
        crowded = F.greatest("un", "vn") > block if halvings < HALVINGS else F.lit(False)
        some = _compared(pairs.where(~crowded), pts, cols, fine, block)
        found = some if found is None else found.unionByName(some)
        pairs = pairs.where(crowded)
        most = pairs.agg(F.max(F.greatest("un", "vn"))).first()[0]
        if most is None:
            return found.where(F.col("d") <= radius)
        # at once as often as it may take, if that makes few parts
        bits = max(1, min(math.ceil(math.log2(most / block)), 6 // cols))
        pairs = pairs.select("a", "b", "u", "v")
        fine /= 2 ** bits
        of = pairs.select(F.explode(F.array("u", "v")).alias("of")).distinct()
        parts = pts.select("x", _cell(F.col("x"), fine).alias("cell")).withColumn(
            "of", F.transform("cell", lambda v: F.shiftright(v, bits))).join(of, "of", "left_semi")
        parts = materialize(parts.groupBy("of", "cell").agg(F.count("*").alias("n"), *_boxes("x", "x", cols)))
        halves = pairs.toDF("a", "b", "uo", "vo")
        for u in "uv":
            halves = halves.join(side(parts, u, F.col("of").alias(f"{u}o")), f"{u}o")
        pairs = materialize(_close(halves, radius))


def single_linkage(df: DataFrame, cols: list[str] | None = None, cell: int = CELL, block: int = BLOCK,
                   one_task: int = ONE_TASK, scale: bool = True) -> tuple[DataFrame, DataFrame]:
    """Points ``(pid, x, w, rep)`` (distinct, with their rows) and the tree ``(a, b, d, rep)`` over their ids.

    ``scale``: standardise the columns first.  Edge ends stand for the components they join, shorter edges drawn.
    Edges with a ``rep`` of 0 or more join the points of the same ``rep``; all others have -1.
    """
    cols = cols or numeric_columns(df)
    ensure_checkpoint_dir(df.sparkSession)
    z = complete_cases(df.select(*cols), cols)
    z = standardize(z, cols) if scale else clean_numeric(z, cols)
    pts = z.groupBy(*cols).agg(F.count("*").alias("w")).select(F.array(*cols).alias("x"), "w")
    pts = materialize(pts.withColumn("pid", F.monotonically_increasing_id()))
    span = pts.agg(F.count("*").alias("n"), *[f(F.get("x", F.lit(j))).alias(f"{k}{j}") for j in range(len(cols)) for k, f in (
        ("l", F.min), ("h", F.max))]).first()
    widths = [(span[f"h{j}"] or 0.0) - (span[f"l{j}"] or 0.0) for j in range(len(cols))]
    if span.n < 2:
        return pts.withColumn("rep", F.col("pid")), df.sparkSession.createDataFrame([], "a long, b long, d double, rep long")
    # the grid runs over the widest columns, which come first
    order = sorted(range(len(cols)), key=lambda j: -widths[j])
    pts = materialize(pts.withColumn("x", F.array(*[F.get("x", F.lit(j)) - F.lit(span[f"l{j}"]) for j in order])))
    dims = min(GRID_COLUMNS, len(cols))
    radius = _first_radius(pts, dims, max(widths), cell)
    first = materialize(_level_0(pts, len(cols), dims, radius))
    nodes = first.where("d IS NULL").select(F.col("a").alias("pid"), F.col("b").alias("node"))
    border, comp = _minimum_forest(_joined(first.where("d IS NOT NULL AND rep < 0"), nodes), one_task)
    tree = materialize(first.where("d IS NOT NULL AND rep >= 0").unionByName(border.withColumn("rep", F.lit(-1).cast("long"))))
    found = tree.count()
    pts = materialize(pts.join(nodes.withColumnRenamed("node", "rep"), "pid"))
    fine = radius / math.sqrt(len(cols)) * (1 - 1e-9)
    cells = _labelled(pts.select("x", F.col("rep").alias("comp")), "comp", comp).groupBy(_cell(F.col("x"), fine).alias("cell"))
    cells = materialize(cells.agg(F.min("comp").alias("comp"), F.count("*").alias("n"), *_boxes("x", "x", len(cols))))
    while found < span.n - 1:
        # among few cells the next radius may be much larger: their pairs are few whatever it is
        bits = 3 if cells.count() <= FEW_CELLS else 1
        radius *= 2 ** bits
        edges = _between(cells, pts, len(cols), dims, fine, radius, block)
        more, comp = _minimum_forest(edges.withColumns({"p": F.least("a", "b"), "q": F.greatest("a", "b")}), one_task)
        n = more.count()
        if n:
            cells = _labelled(cells, "comp", comp)
            tree = tree.unionByName(more.withColumn("rep", F.lit(-1).cast("long")))
            found += n
        fine *= 2 ** bits
        if found < span.n - 1:
            cells = materialize(cells.groupBy(F.transform("cell", lambda v: F.shiftright(v, bits)).alias("cell")).agg(
                F.min("comp").alias("comp"), F.sum("n").alias("n"), *_boxes("low", "high", len(cols))))
    return pts, materialize(tree)


def merge_heights(df: DataFrame, cols: list[str] | None = None, **options) -> DataFrame:
    """``(height, merges)``: how many merges happen at each height; rows - 1 merges in all."""
    pts, tree = single_linkage(df, cols, **options)
    same = pts.agg(F.sum(F.col("w") - 1).alias("merges")).select(F.lit(0.0).alias("height"), "merges").where("merges > 0")
    return tree.groupBy(F.col("d").alias("height")).agg(F.count("*").alias("merges")).unionByName(same)


def _parted(pts: DataFrame, tree: DataFrame, clusters: int, one_task: int = ONE_TASK) -> tuple[DataFrame, list]:
    """Points ``(pid, x, w, cluster)`` without the ``clusters - 1`` longest edges, and those edges."""
    top = tree.orderBy(F.desc("d"), "a", "b").limit(clusters - 1)
    cut = [tuple(r) for r in top.collect()] if clusters > 1 else []
    # points of one rep stay one node, unless a cut goes through them
    split = tree.sparkSession.createDataFrame([(r,) for r in sorted({r for *_, r in cut if r >= 0})], "rep long")
    split = F.broadcast(split.withColumn("split", F.lit(True)))
    parted = pts.join(split, "rep", "left").withColumn("cluster", F.when(F.col("split"), F.col("pid")).otherwise(F.col("rep")))
    rest = tree.where("rep < 0").unionByName(tree.join(split, "rep", "left_semi"))
    if cut:
        rest = rest.join(F.broadcast(df_of(tree, [c[:3] for c in cut])), ["a", "b"], "left_anti")
    links = _joined(rest, parted.select("pid", "cluster"))
    comp = _minimum_forest(links, one_task)[1]
    return _labelled(parted.select("pid", "x", "w", "cluster"), "cluster", comp), [c[:3] for c in cut]


def df_of(like: DataFrame, rows: list) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, "a long, b long, d double")


def hierarchy(df: DataFrame, cols: list[str] | None = None, last: int = LAST, **options) -> dict[str, DataFrame]:
    """``merges``: the last merges, a dendrogram's top ``(step, height, left_size, right_size, size, n_clusters)``;
    ``summary``: ``(n_rows, best_k, gap)``, the cut within the widest gap between two of these heights.

    ``last`` bounds the dendrogram that is shown; all merges are in :func:`merge_heights`.
    """
    pts, tree = single_linkage(df, cols, **options)
    parted, cut = _parted(pts, tree, last + 1)
    parted = materialize(parted)
    of = {r.pid: r.cluster for r in parted.join(F.broadcast(df_of(tree, cut).select(F.explode(F.array("a", "b")).alias("pid"))
                                                            .distinct()), "pid").select("pid", "cluster").collect()}
    sizes = {r.cluster: r.s for r in parted.where(F.col("cluster").isin(list(set(of.values())))).groupBy("cluster").agg(
        F.sum("w").alias("s")).collect()} if of else {}
    n = pts.agg(F.sum("w")).first()[0] or 0
    rows, up = [], {c: c for c in sizes}

    def find(c):
        while up[c] != c:
            c = up[c]
        return c

    for i, (a, b, d) in enumerate(sorted(cut, key=lambda e: (e[2], -e[0], -e[1]))):
        x, y = find(of[a]), find(of[b])
        small, large = sorted((sizes[x], sizes[y]))
        rows.append((i + 1, float(d), int(large), int(small), int(large + small), len(cut) - i))
        up[x] = y
        sizes[y] = large + small
    gaps = [(rows[i + 1][1] - rows[i][1], rows[i][5]) for i in range(len(rows) - 1)]
    gap, k = max(gaps, key=lambda g: (g[0], -g[1])) if gaps else (None, 1 if n else 0)
    spark = df.sparkSession
    return {"merges": spark.createDataFrame(rows, "step int, height double, left_size long, right_size long, size long, n_clusters int"),
            "summary": spark.createDataFrame([(int(n), int(k), gap)], "n_rows long, best_k int, gap double")}


def cluster_sizes(df: DataFrame, k: int, cols: list[str] | None = None, **options) -> DataFrame:
    """``(cluster, size)`` of the cut into ``k`` clusters, the largest first."""
    pts, tree = single_linkage(df, cols, **options)
    sizes = _parted(pts, tree, k)[0].groupBy("cluster").agg(F.sum("w").alias("size"))
    rows = sorted((int(r["size"]) for r in sizes.collect()), reverse=True)  # k rows
    return df.sparkSession.createDataFrame([(i + 1, s) for i, s in enumerate(rows)], "cluster int, size long")
