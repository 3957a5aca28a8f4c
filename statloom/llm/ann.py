"""Approximate nearest neighbours by a forest of random-projection trees.

Fit: every tree is split on a bounded sample (``SAMPLE`` distinct vectors by
hash order) by the hyperplane halfway between two random points of the node,
down to ``LEAF`` sample points.  Index: every distinct vector is routed to one
leaf of every tree.  Search: one priority queue over all trees of a query holds
(how far on the right side of its hyperplanes, node); the best node is opened
first, its far child goes back with its margin, until the opened leaves hold the
search budget.  Rerank: the vectors of the opened leaves are compared with the
query exactly, in double precision, and the best of every leaf block merge.

The search budget is a share of the index, the same at every size: among
almost isotropic vectors a constant budget would lose recall as the index grows.

Leaves of more than ``BLOCK`` vectors are cut into blocks and queries go to each
block; the queries of a block are cut into groups of about ``BLOCK``.  Vectors with equal components are indexed once with their ``k + 1``
smallest ids (no more can be among k results), so a vector that a third of all
rows share is one index entry.

Cases: vectors that are null, empty, zero or hold null or non-finite components
take no part; vectors are compared only with others of the same length; ties go
to the smaller id; an empty table or a table without a query gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.llm.common import materialize

SAMPLE = 16_384
TREES = 10
LEAF = 64
#: Share of all index entries, over all trees, that a query opens.
SHARE = 0.12
BLOCK = 4_096
SEED = 11


def usable(vector):
    """True where a vector can take part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0.0)
    return F.coalesce(vector.isNotNull() & fine & some, F.lit(False))


class Forest:
    """Hyperplanes of all trees in one matrix; child >= 0 is a node, < 0 is leaf ~child."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.planes, self.offsets, self.kids, self.roots, self.leaves = [], [], [], [], 0
        self.dim = sample.shape[1]
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), leaf, rng))
        self.planes = np.array(self.planes, np.float64).reshape(-1, self.dim)
        self.offsets = np.array(self.offsets, np.float64)
        self.kids = np.array(self.kids, np.int64).reshape(-1, 2)

    def _grow(self, x, rows, leaf, rng) -> int:
        if len(rows) > leaf:
            for _ in range(5):
                a, b = rng.choice(rows, 2, replace=False)
                plane = x[a] - x[b]
                size = np.linalg.norm(plane)
                if not size:
                    continue
                plane = plane / size
                offset = -plane @ (x[a] + x[b]) / 2
                right = x[rows] @ plane + offset > 0
                if right.any() and not right.all():
                    at = len(self.planes)
                    self.planes.append(plane)
                    self.offsets.append(offset)
                    self.kids.append((0, 0))
                    self.kids[at] = (self._grow(x, rows[~right], leaf, rng), self._grow(x, rows[right], leaf, rng))
                    return at
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row in every tree, rows x trees."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            stack = [(root, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if node < 0:
                    out[rows, t] = ~node
                    continue
                right = x[rows] @ self.planes[node] + self.offsets[node] > 0
                for side, own in ((0, rows[~right]), (1, rows[right])):
                    if len(own):
                        stack.append((int(self.kids[node, side]), own))
        return out

    def search(self, q: np.ndarray, sizes: np.ndarray, budget: float) -> list[int]:
        """Leaves to open for one query, best first, until they hold ``budget`` entries."""
        margins = (self.planes @ q + self.offsets).tolist()
        kids = self.kids_list()
        queue = [(-np.inf, r) for r in self.roots]
        heapq.heapify(queue)
        got, opened = 0, []
        while queue and got < budget:
            far, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                side = m > 0
                heapq.heappush(queue, (max(far, abs(m)), kids[node][not side]))
                node = kids[node][side]
            if sizes[~node]:
                opened.append(~node)
                got += sizes[~node]
        return opened

    def kids_list(self):
        if not hasattr(self, "_kids"):
            self._kids = [tuple(k) for k in self.kids.tolist()]
        return self._kids


def entries(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """v, ids: every distinct usable vector with its k + 1 smallest ids."""
    rows = vectors.where(usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    w = Window.partitionBy("v").orderBy("id")
    few = rows.where("id IS NOT NULL").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _packed(x: np.ndarray) -> list[bytes]:
    """Vectors as the bytes of their doubles, which travel and unpack cheaper than arrays."""
    return [v.tobytes() for v in x]


def _unpacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, leaf: int = LEAF,
            share: float = SHARE, sample: int = SAMPLE, block: int = BLOCK,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query row, its own id left out."""
    spark = vectors.sparkSession
    held = materialize(entries(vectors, k, id_col, vec_col))
    total = held.count()
    few = held.select("v", F.xxhash64("v").alias("h"))
    if total > 2 * sample:  # a threshold on the hash leaves about twice the sample before the merge
        few = few.where(F.pmod("h", F.lit(1 << 40)) < F.lit(int((1 << 40) * 2.0 * sample / total)))
    drawn = few.orderBy("h", "v").limit(sample).toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in drawn:
        by_dim.setdefault(len(v), []).append(v)
    forests = spark.sparkContext.broadcast({d: Forest(_stack(v), trees, leaf) for d, v in by_dim.items()})

    def route(parts):
        for pdf in parts:
            dims = pdf["v"].map(len)
            for d in dims.unique():
                own = pdf[dims == d]
                f = forests.value.get(int(d))
                x = _stack(own["v"])
                at = f.route(x) if f else np.zeros((len(own), 1), np.int64)  # lengths not in the sample
                yield pd.DataFrame({"v": _packed(x), "ids": own["ids"], "dim": int(d), "leaves": list(at)})

    indexed = materialize(held.mapInPandas(route, "v binary, ids array<long>, dim int, leaves array<long>"))
    counts = indexed.select("dim", F.explode("leaves").alias("leaf")).groupBy("dim", "leaf").count().collect()
    sizes = spark.sparkContext.broadcast({(r.dim, r.leaf): r["count"] for r in counts})  # at most the forest's leaves

    def find(parts):
        lists = {d: [sizes.value.get((d, i), 0) for i in range(f.leaves)] for d, f in forests.value.items()}
        for pdf in parts:
            for q, v in zip(pdf["id"], pdf["v"]):
                d, v = len(v), np.asarray(v, np.float64)
                f = forests.value.get(d)
                opened = f.search(v, lists[d], share * total * trees) if f else [0]
                packed = v.tobytes()
                yield pd.DataFrame([(q, packed, d, i, b) for i in opened for b in range(-(-sizes.value.get((d, i), 0) // block))],
                                   columns=["query_id", "v", "dim", "leaf", "blk"])

    asked = queries.where(usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL")
    wanted = asked.mapInPandas(find, "query_id long, v binary, dim int, leaf long, blk int")
    leaf_sizes = F.broadcast(spark.createDataFrame([(r.dim, r.leaf, -(-r["count"] // block)) for r in counts],
                                                   "dim int, leaf long, blks long"))
    units = indexed.select("v", "ids", "dim", F.explode("leaves").alias("leaf")).join(leaf_sizes, ["dim", "leaf"])
    units = units.withColumn("blk", F.pmod(F.xxhash64("v"), F.col("blks")).cast("int"))

    def rerank(q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(e):
            return pd.DataFrame([], columns=["query_id", "ids", "score"])
        x, y, ids = _unpacked(e["v"]), _unpacked(q["v"]), e["ids"].to_numpy()
        near, xx = k + 1, (x * x).sum(1)
        rows = []
        for i, qid in enumerate(q["query_id"]):
            rough = xx - 2 * (x @ y[i])
            if len(x) > near:
                bar = np.partition(rough, near - 1)[near - 1]
                pick = np.flatnonzero(rough <= bar + 1e-9 * max(1.0, abs(bar), float(xx.max())))
            else:
                pick = np.arange(len(x))
            exact = np.sqrt(((x[pick] - y[i]) ** 2).sum(1))
            best = sorted(zip(exact.tolist(), (ids[p][0] for p in pick), pick.tolist()))[:near]
            rows += [(qid, ids[p], s) for s, _, p in best]
        return pd.DataFrame(rows, columns=["query_id", "ids", "score"])

    wanted = materialize(wanted)
    asks = wanted.groupBy("dim", "leaf", "blk").agg(F.ceil(F.count("*") / block).cast("int").alias("grps"))
    wanted = wanted.join(asks, ["dim", "leaf", "blk"]).withColumn("grp", F.pmod(F.xxhash64("query_id"), F.col("grps")).cast("int"))
    units = units.join(asks.toDF("dim", "leaf", "blk", "grps"), ["dim", "leaf", "blk"]).withColumn(
        "grp", F.explode(F.sequence(F.lit(0), F.col("grps") - 1)))
    keys = ["dim", "leaf", "blk", "grp"]
    found = wanted.drop("grps").groupBy(*keys).cogroup(units.select("v", "ids", *keys).groupBy(*keys)).applyInPandas(
        rerank, "query_id long, ids array<long>, score double")
    pairs = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
    once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
