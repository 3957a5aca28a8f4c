"""Hard negatives by a multiway tree of split points with distance ranges (GNAT).

Vectors become whole numbers, floor(256 x), so that scores (inner products) are
exact.  A bounded sample chooses the split points of every node, far from each
other; a vector goes to the nearest split point's subtree, down to a leaf, and
every vector of the table is indexed.  Each split point keeps the range of its
distances to the vectors of every sibling subtree, taken over all vectors, and
each subtree the range of its norms.  As score = (|a|^2 + |x|^2 - d^2) / 2, a
window of scores is an annulus of distances around the anchor; a subtree is
left out when, for some split point beside it, the distances that the triangle
inequality allows do not meet that annulus.  Vectors of the leaves that remain
are compared exactly, so the result is exact whatever is left out.

Two searches run: first the positives (score window from the fifth best so far
up), then the negatives (window from 0.8 of the smallest to the largest positive
score, narrowed by the fifth found per positive).  Each first opens the best
leaves of every anchor, then all others that may still matter.  Leaves are cut
into blocks and the anchors of a block into groups, so that neither a leaf that
a third of all rows share nor many anchors meet in one task; a task returns at
most k rows per anchor and window.

Cases: rows with a null id, label or vector, or with a null or non-finite
component, take no part; vectors are compared only with others of their length;
rows alike in id, label and vector count once, and rows with the anchor's id are
never its partners; equal scores go by the smaller id;
an anchor without positives, or without negatives in the window, gives no rows;
scores beyond 64 bits are held as the nearest 64-bit number; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.llm.common import materialize

#: Vectors that choose the split points; children of a node; sample vectors of a leaf.
SAMPLE = 8_192
FANOUT = 12
LEAF = 128
#: Vectors of a block and anchors of a group that meet in one task.
BLOCK = 2_048
ANCHORS = 2_048
#: Leaves that a search opens first, by the vectors they hold.
FIRST = 2_048
SEED = 13
EXACT = 2.0 ** 53
LONGEST = 2 ** 63 - 1


class Tree:
    """Split points, children (leaf i as ~i) and, once filled, ranges of one vector length."""

    def __init__(self, sample: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF, seed: int = SEED):
        self.rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, list[int]]] = []  # split points, children
        self.paths: list[list[int]] = []  # of every leaf: its nodes from the root down
        self.root = self._grow(sample, [], fanout, leaf)
        del self.rng

    def _grow(self, x: np.ndarray, path: list[int], fanout: int, leaf: int) -> int:
        if len(x) > leaf:
            split = x[self._apart(x, fanout)]
            home = distances(x, split).argmin(1)
            if np.ptp(home):  # distances beyond a double's range tell nothing apart
                at = len(self.nodes)
                self.nodes.append((split, []))
                self.nodes[at][1].extend(self._grow(x[home == c], [*path, at], fanout, leaf) for c in range(len(split)))
                return at
        self.paths.append(path)
        return ~(len(self.paths) - 1)

    def _apart(self, x: np.ndarray, m: int) -> list[int]:
        """Rows far from each other: each next one is the farthest from those chosen, of a few drawn at random."""
        drawn = self.rng.permutation(len(x))[:16 * m]
        got = [0]
        gap = distances(x[drawn], x[drawn[:1]])[:, 0]
        while len(got) < m and gap.max() > 0:
            got.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(x[drawn], x[drawn[got[-1:]]])[:, 0])
        return drawn[got].tolist()

    def route(self, x: np.ndarray):
        """For every leaf with rows: leaf, rows, {node: distances of the rows to its split points}."""
        stack = [(self.root, np.arange(len(x)), {})]
        while stack:
            node, rows, seen = stack.pop()
            if node < 0:
                yield ~node, rows, seen
                continue
            split, kids = self.nodes[node]
            d = distances(x[rows], split)
            home = d.argmin(1)
            for c, kid in enumerate(kids):
                own = home == c
                if own.any():
                    stack.append((kid, rows[own], {n: v[own] for n, v in seen.items()} | {node: d[own]}))

    def fill(self, ranges: dict, norms: dict) -> None:
        """``ranges``: (leaf, node, split point) -> (lowest, highest) distance; ``norms``: leaf -> the same of norms."""
        self.low, self.high = [], []
        for split, kids in self.nodes:
            self.low.append(np.full((len(kids), len(split)), np.inf))
            self.high.append(np.full((len(kids), len(split)), -np.inf))
        self.norm = {}
        for leaf, path in enumerate(self.paths):
            if leaf not in norms:
                continue  # no vector came here
            low, high = norms[leaf]
            for here, below in zip(path, [*path[1:], ~leaf]):
                c = self.nodes[here][1].index(below)
                for s in range(len(self.nodes[here][0])):
                    a, b = ranges[leaf, here, s]
                    self.low[here][c, s] = min(self.low[here][c, s], a)
                    self.high[here][c, s] = max(self.high[here][c, s], b)
            for at in [*path, ~leaf]:
                was = self.norm.get(at, (np.inf, -np.inf))
                self.norm[at] = (min(was[0], low), max(was[1], high))

    def search(self, a: np.ndarray, window: tuple[float, float]):
        """(most the score can be, leaf) of every leaf that may hold scores within ``window``."""
        own = float(np.sqrt((a * a).sum()))
        stack, out = [(self.root, own * self.norm[self.root][1])] if self.root in self.norm else [], []
        while stack:
            node, most = stack.pop()
            if node < 0:
                out.append((most, ~node))
                continue
            split, kids = self.nodes[node]
            d = distances(a[None], split)[0]
            near = np.maximum(np.maximum(self.low[node] - d, d - self.high[node]).max(1), 0)
            far = (self.high[node] + d).min(1)
            for c, kid in enumerate(kids):
                if kid not in self.norm:
                    continue
                low, high = self.norm[kid]
                top = min((own * own + high * high - near[c] ** 2) / 2, own * high)
                least = max((own * own + low * low - far[c] ** 2) / 2, -own * high)
                slack = 1e-9 * (own * own + high * high) + 1e-6
                # comparisons that numbers too large turn into nan leave the subtree in
                if not (top + slack < window[0] or least - slack > window[1]):
                    stack.append((kid, top))
        return out


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of x by rows of y."""
    return np.stack([np.sqrt(((x - v) ** 2).sum(1)) for v in y], 1)


def scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows, anchors by vectors, as int64."""
    most = (np.abs(x).max(initial=0) * np.abs(a).max(initial=0)) * max(x.shape[1], 1)
    if most < EXACT:
        return (a @ x.T).astype(np.int64)
    whole = [[int(c) for c in v] for v in x.tolist()]  # beyond a double's whole numbers: Python's
    return np.array([[max(-LONGEST, min(LONGEST, sum(map(int.__mul__, map(int, v), w)))) for w in whole]
                     for v in a.tolist()], np.int64).reshape(len(a), len(x))


def prepare(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, label, x (packed whole numbers), dim of every row that takes part, each distinct row once."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col(vec_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL")

    def run(parts):
        for pdf in parts:
            dims = pdf["v"].map(len).to_numpy()
            for d in np.unique(dims):
                own = pdf[dims == d]
                x = np.floor(np.concatenate(own["v"].to_numpy()).reshape(len(own), d).astype(np.float64) * 256.0) + 0.0
                x = np.clip(x, -1e300, 1e300)
                yield pd.DataFrame({"id": own["id"], "label": own["label"], "x": [r.tobytes() for r in x], "dim": int(d)})

    return rows.mapInPandas(run, "id long, label long, x binary, dim int").distinct()


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Index:
    """Blocks of all vectors by leaf, and the trees."""

    def __init__(self, held: DataFrame, sample: int = SAMPLE, fanout: int = FANOUT, leaf: int = LEAF,
                 block: int = BLOCK, seed: int = SEED):
        spark = held.sparkSession
        n = held.count()
        # a threshold on the hash leaves about the sample's size before the sort
        few = held.select("x", "dim", F.xxhash64("x", F.lit(seed)).alias("h"))
        if n > 2 * sample:
            few = few.where(F.pmod(F.col("h"), F.lit(1 << 40)) < F.lit(int((1 << 40) * 2.0 * sample / n)))
        drawn = few.orderBy("h", "x").limit(sample).toPandas()
        trees = {int(d): Tree(np.unique(_matrix(g["x"].tolist()), axis=0), fanout, leaf, seed)
                 for d, g in drawn.groupby("dim") if d}
        grown = spark.sparkContext.broadcast(trees)

        def route(parts):
            for pdf in parts:
                for d, own in pdf.groupby("dim"):
                    tree = grown.value.get(int(d))
                    at = np.zeros(len(own), np.int64)
                    for leaf_no, rows, _ in tree.route(_matrix(own["x"].tolist())) if tree else ():
                        at[rows] = leaf_no
                    yield own.assign(leaf=at)

        routed = materialize(held.mapInPandas(route, "id long, label long, x binary, dim int, leaf long"))

        def measure(parts):
            for pdf in parts:
                for d, own in pdf.groupby("dim"):
                    tree = grown.value.get(int(d))
                    if not tree:
                        continue
                    x = _matrix(own["x"].tolist())
                    got = []
                    for leaf_no, rows, seen in tree.route(x):
                        size = np.sqrt((x[rows] ** 2).sum(1))
                        got.append((int(d), leaf_no, -1, -1, size.min(), size.max()))
                        got += [(int(d), leaf_no, node, s, v[:, s].min(), v[:, s].max())
                                for node, v in seen.items() for s in range(v.shape[1])]
                    yield pd.DataFrame(got, columns=["dim", "leaf", "node", "split", "low", "high"])

        ranges = routed.select("x", "dim").mapInPandas(
            measure, "dim int, leaf long, node long, split long, low double, high double")
        ranges = ranges.groupBy("dim", "leaf", "node", "split").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        by_dim: dict[int, tuple[dict, dict]] = {d: ({}, {}) for d in trees}
        for r in ranges.collect():  # a few numbers for every leaf of trees of a bounded sample
            if r.node < 0:
                by_dim[r.dim][1][r.leaf] = (r.low, r.high)
            else:
                by_dim[r.dim][0][r.leaf, r.node, r.split] = (r.low, r.high)
        for d, tree in trees.items():
            tree.fill(*by_dim[d])
        self.sizes = {(r.dim, r.leaf): r["count"] for r in routed.groupBy("dim", "leaf").count().collect()}
        self.trees = spark.sparkContext.broadcast(trees)
        self.blocks = {k: -(-c // block) for k, c in self.sizes.items()}
        table = F.broadcast(spark.createDataFrame([(*k, b) for k, b in self.blocks.items()], "dim int, leaf long, blks int"))
        self.units = routed.join(table, ["dim", "leaf"]).withColumn(
            "blk", F.pmod(F.xxhash64("id", "label", "x"), F.col("blks")).cast("int")).drop("blks")

    def meet(self, asked: DataFrame, columns: str, first: bool, work, result: str) -> DataFrame:
        """``work(anchors, vectors)`` of every block and group of anchors that must meet.

        ``asked``: columns (as in ``columns``) with id, x, dim and the window low, high.  The
        first round opens the best leaves, the second all others that meet the window.
        """
        trees, sizes, blocks = self.trees, self.sizes, self.blocks
        names = [c.split()[0] for c in columns.split(", ")]

        def leaves(d: int, a: np.ndarray, window):
            """Leaves of the first round, or of the second."""
            tree = trees.value.get(d)
            if tree is None:
                return [] if not first else [0]
            got, best = 0, []
            for most, leaf in sorted(tree.search(a, (-np.inf, np.inf)), key=lambda e: (-e[0], e[1])):
                if got >= FIRST:
                    break
                best.append(leaf)
                got += sizes[d, leaf]
            if first:
                return best
            seen = set(best)
            return [leaf for _, leaf in tree.search(a, window) if leaf not in seen]

        def find(parts):
            for pdf in parts:
                at, leaf_of, blk_of = [], [], []
                for i, (x, d, low, high) in enumerate(zip(pdf["x"], pdf["dim"], pdf["low"], pdf["high"])):
                    for leaf in leaves(int(d), np.frombuffer(x), (low, high)):
                        for b in range(blocks.get((int(d), leaf), 0)):
                            at.append(i)
                            leaf_of.append(leaf)
                            blk_of.append(b)
                yield pdf[names].iloc[at].assign(leaf=leaf_of, blk=blk_of)

        wanted = materialize(asked.select(*names).mapInPandas(find, f"{columns}, leaf long, blk int"))
        asks = wanted.groupBy("dim", "leaf", "blk").agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("grps"))
        wanted = wanted.join(asks, ["dim", "leaf", "blk"]).withColumn(
            "grp", F.pmod(F.xxhash64("id", "x"), F.col("grps")).cast("int")).drop("grps")
        units = self.units.join(asks.toDF("dim", "leaf", "blk", "grps"), ["dim", "leaf", "blk"])
        units = units.withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("grps") - 1))).drop("grps")
        keys = ["dim", "leaf", "blk", "grp"]
        return wanted.groupBy(*keys).cogroup(units.groupBy(*keys)).applyInPandas(work, result)


def _best(score: np.ndarray, ids: np.ndarray, fit: np.ndarray, k: int) -> np.ndarray:
    """The k fitting columns of highest score, ties by the smaller id."""
    at = np.flatnonzero(fit)
    if len(at) > k:
        bar = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= bar]
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _top(found: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, margin: int = 80,
         id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A negative's score is at most the positive's and at least ``margin`` percent of it.
    """
    held = materialize(prepare(vectors, id_col, vec_col, label_col))
    asked = materialize(prepare(anchors, id_col, vec_col, label_col))
    index = Index(held, **options)
    base = "id long, label long, x binary, dim int, low double, high double"
    empty = ["anchor", "anchor_label", "ax", "other", "score"]

    def alike(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(e):
            ids, labels = e["id"].to_numpy(), e["label"].to_numpy()
            s = scores(_matrix(e["x"].tolist()), _matrix(q["x"].tolist()))
            for i, (a, label, x) in enumerate(zip(q["id"], q["label"], q["x"])):
                best = _best(s[i], ids, (labels == label) & (ids != a), positives)
                out += [(a, label, x, int(ids[j]), int(s[i, j])) for j in best]
        return pd.DataFrame(out, columns=empty)

    row = "anchor long, anchor_label long, ax binary, other long, score long"
    me = ["anchor", "anchor_label", "ax"]
    order = [F.desc("score"), "other"]
    open_window = asked.withColumns({"low": F.lit(-np.inf), "high": F.lit(np.inf)})
    near = materialize(_top(index.meet(open_window, base, True, alike, row), me, order, positives).drop("rank"))
    bar = near.groupBy(*me).agg(F.count("*").alias("c"), F.min("score").alias("s"))
    known = asked.join(bar.toDF("id", "label", "x", "c", "s"), ["id", "label", "x"], "left")
    known = known.withColumns({"low": F.when(F.col("c") >= positives, F.col("s").cast("double")).otherwise(-np.inf),
                               "high": F.lit(np.inf)})
    rest = index.meet(known, base, False, alike, row)
    positive = materialize(_top(near.unionByName(rest), me, order, positives))

    # one row per anchor with the scores of its positives; below zero no negative can lie within the window
    windows = positive.where("score >= 0").groupBy(*me).agg(F.sort_array(F.collect_list("rank")).alias("ranks"),
                                                            F.sort_array(F.collect_list("score"), False).alias("tops"))
    windows = windows.toDF("id", "label", "x", "ranks", "tops").join(asked, ["id", "label", "x"])

    def unlike(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(e):
            ids, labels = e["id"].to_numpy(), e["label"].to_numpy()
            s = scores(_matrix(e["x"].tolist()), _matrix(q["x"].tolist()))
            for i, (a, label, x, ranks, tops) in enumerate(zip(q["id"], q["label"], q["x"], q["ranks"], q["tops"])):
                other = (labels != label) & (ids != a)
                for nth, top in zip(ranks, tops):
                    least = -(-margin * int(top) // 100)
                    for j in _best(s[i], ids, other & (s[i] <= top) & (s[i] >= least), negatives):
                        out.append((a, label, x, int(nth), int(ids[j]), int(s[i, j])))
        return pd.DataFrame(out, columns=["anchor", "anchor_label", "ax", "nth", "other", "score"])

    base = f"{base}, ranks array<int>, tops array<long>"
    row = "anchor long, anchor_label long, ax binary, nth int, other long, score long"
    lowest = F.array_min("tops").cast("double") * (margin / 100)
    wide = windows.withColumns({"low": lowest, "high": F.array_max("tops").cast("double")})
    nth = [*me, "nth"]
    near = materialize(_top(index.meet(wide, base, True, unlike, row), nth, order, negatives).drop("rank"))
    # a positive with all its negatives found needs nothing below the last of them
    full = near.groupBy(*nth).agg(F.count("*").alias("c"), F.min("score").alias("s")).where(F.col("c") >= negatives)
    full = full.groupBy(*me).agg(F.map_from_entries(F.collect_list(F.struct("nth", "s"))).alias("full"))
    known = wide.join(full.toDF("id", "label", "x", "full"), ["id", "label", "x"], "left")
    need = F.transform(F.arrays_zip("ranks", "tops"), lambda p: F.coalesce(
        F.element_at("full", p["ranks"]).cast("double"), p["tops"].cast("double") * (margin / 100)))
    rest = index.meet(known.withColumn("low", F.array_min(need)), base, False, unlike, row)
    negative = _top(near.unionByName(rest), nth, order, negatives)
    p = positive.select(*me, F.col("rank").alias("nth"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return negative.join(p, nth).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The rows of the query: where vec_id is divisible by 7, the label moves one on, modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.select("vec_id", label.alias("label"), "embedding")


#: DuckDB's version of op13 over the view ``embeddings``.
SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
s AS (
  SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS alike,
         list_inner_product(a.x, o.x)::BIGINT AS score
  FROM e a JOIN e o ON a.vec_id <> o.vec_id AND len(a.x) = len(o.x) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.alike
  AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5
"""
