"""Embedding near-duplicates: an exact metric range join.

Unit vectors with cosine >= ``threshold`` lie within r = sqrt(2 - 2 threshold).
Only vectors of one label are compared, so every label has pivots of its own, one for
``PER_PIVOT`` of its vectors (by hash order); they cut its vectors into cells, and a vector's
home is its nearest pivot's cell.  A label of fewer vectors is one cell.  It is copied to another pivot's cell only if
that cell can hold a partner: by the triangle inequality the partner's home
distance is at least d - r, so it needs d(pivot) - d(home pivot) <= 2 r and
d(pivot) - r <= the cell's radius, and the plane halfway between both pivots
must lie within r.  Every cell is joined on its own; a home vector sees all its
partners there, so its links are counted once, and each cell returns the star
edges of its local components instead of pairs.

Equal vectors of one label are one weighted vector.  Cells above ``CELL``
vectors are cut into block pairs.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, nor do rows with a null label, and vectors of different
length are never compared; rows sharing a vec_id are one node but count each;
a null vec_id links like any other; empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.llm.ann import usable
from statloom.llm.common import materialize
from statloom.functions.components import connected_components
from statloom.llm.simhash import star_edges

THRESHOLD = 0.98
#: Vectors of a label that a pivot stands for, and the most pivots that are sent to every task.
PER_PIVOT = 5_000
MAX_PIVOTS = 2_048
CELL = 4_096
ROWS = 256

#: DuckDB's version of op10 over the view ``embeddings``.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(n, m) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.a, r.m FROM r JOIN p ON p.b = r.n),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.n = e.vec_id LEFT JOIN k ON k.a = e.vec_id
"""


def _units(column) -> np.ndarray:
    """Unit vectors in double precision; scaled by the largest component first, so that no square overflows or vanishes."""
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _linked(a: np.ndarray, x: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix of cosines >= threshold; those at the edge are summed again without BLAS."""
    cos = a @ x.T
    hit = cos >= threshold
    for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12)):
        hit[i, j] = math.fsum((a[i] * x[j]).tolist()) >= threshold
    return hit


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, per_pivot: int = PER_PIVOT,
                    max_pivots: int = MAX_PIVOTS, cell: int = CELL, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    spark = vectors.sparkSession
    r = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-12
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                          F.col(vec_col).alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    # the copies of a vector share its hash; equal hashes are told apart by the vector itself
    rows = materialize(rows.withColumn("h", F.when(F.col("ok"), F.xxhash64("label", "v"))))
    held = materialize(rows.where("ok").groupBy("h", "label", "v").agg(
        F.min("vec_id").alias("node"), F.count("*").alias("copies")).withColumn("key", F.monotonically_increasing_id()))
    # the labels large enough for two pivots, the largest first where the bound on pivots would be passed
    group = held.groupBy("label", F.size("v").alias("dim")).count().where(F.col("count") > per_pivot)
    group = group.orderBy(F.desc("count"), "label", "dim").limit(max_pivots).collect()
    wanted = [math.ceil(g["count"] / per_pivot) for g in group]
    less = min(1.0, max_pivots / max(sum(wanted), 1))
    group = [(g.label, g.dim, max(1, int(k * less)), min(1.0, 4.0 * k / g["count"])) for g, k in zip(group, wanted)]
    table = F.broadcast(spark.createDataFrame(group, "label string, dim int, k int, share double"))
    few = held.select("label", F.size("v").alias("dim"), "v", F.xxhash64("v", F.lit(7)).alias("o")).join(table, ["label", "dim"])
    few = few.where(F.pmod("o", F.lit(1 << 40)) <= F.col("share") * float(1 << 40))
    nth = F.row_number().over(Window.partitionBy("label", "dim").orderBy("o", "v"))
    drawn: dict[tuple, list] = {}
    for label, dim, v in few.withColumn("nth", nth).where("nth <= k").select("label", "dim", "v").collect():  # at most max_pivots
        drawn.setdefault((label, dim), []).append(v)
    pivots = spark.sparkContext.broadcast({g: np.unique(_units(v), axis=0) for g, v in drawn.items()})

    def distances(pdf):
        """For each label with pivots, and each length of all others: rows, unit vectors, pivots and the distances to them."""
        dims, labels = pdf["v"].map(len).to_numpy(), pdf["label"].to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            split = np.array([(c, int(d)) in pivots.value for c in labels[at]])
            for label in [*np.unique(labels[at[split]].astype(str)), None]:
                own = at[split & (labels[at] == label)] if label is not None else at[~split]
                if not len(own):
                    continue
                u = _units(pdf["v"].iloc[own])
                p = np.zeros((1, int(d))) if label is None else pivots.value[label, int(d)]
                yield label, int(d), own, u, p, np.sqrt(np.maximum((u * u).sum(1)[:, None] + (p * p).sum(1) - 2 * u @ p.T, 0))

    def homes(parts):
        for pdf in parts:
            for label, d, own, _, _, dist in distances(pdf):
                home = dist.argmin(1)
                yield pd.DataFrame({"label": label, "dim": d, "cell": home, "far": dist[np.arange(len(own)), home]})

    cells = held.mapInPandas(homes, "label string, dim int, cell int, far double").groupBy("label", "dim", "cell").agg(
        F.max("far").alias("far")).collect()  # one row per pivot, and one per length
    radius = spark.sparkContext.broadcast({(c.label, c.dim, c.cell): c.far for c in cells})

    def assign(parts):
        for pdf in parts:
            for label, d, own, u, p, dist in distances(pdf):
                home = dist.argmin(1)
                near = dist[np.arange(len(own)), home][:, None]
                far = np.array([radius.value.get((label, d, c), -9.0) for c in range(len(p))])
                gap = np.sqrt(np.maximum((p * p).sum(1)[:, None] + (p * p).sum(1) - 2 * p @ p.T, 0))[home]
                slack = 1e-6
                go = (dist <= near + 2 * r + slack) & (dist <= far + r + slack)
                go &= dist ** 2 - near ** 2 <= 2 * gap * r + slack
                go[np.arange(len(own)), home] = True
                i, c = np.nonzero(go)
                for s in range(0, len(i), 2_000):
                    at, cs = i[s:s + 2_000], c[s:s + 2_000]
                    got = pdf.iloc[own[at]]
                    yield pd.DataFrame({"key": got["key"], "label": got["label"], "node": got["node"],
                                        "copies": got["copies"], "u": [x.tobytes() for x in u[at]], "dim": d, "cell": cs,
                                        "home": home[at] == cs})

    member = materialize(held.select("key", "label", "node", "copies", "v").mapInPandas(
        assign, "key long, label string, node long, copies long, u binary, dim int, cell int, home boolean"))
    keys = ["label", "dim", "cell"]
    sizes = member.groupBy(*keys).agg(F.ceil(F.count("*") / cell).cast("int").alias("blks"))
    member = member.join(sizes, keys).withColumn("blk", F.pmod(F.xxhash64("key"), F.col("blks")).cast("int"))
    # block pair (i, j): the home vectors of block i against all members of block j
    # (side 1: member only, 2: also a home vector of the pair, 0: home vector only)
    k = F.explode(F.sequence(F.lit(0), F.col("blks") - 1)).alias("k")
    each = member.select("*", k)
    right = each.withColumns({"i": F.col("k"), "j": F.col("blk"),
                              "side": F.when(F.col("home") & (F.col("k") == F.col("blk")), 2).otherwise(1)})
    left = each.where("home AND k <> blk").withColumns({"i": F.col("blk"), "j": F.col("k"), "side": F.lit(0)})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        side = pdf["side"].to_numpy()
        a, b = pdf[side != 1], pdf[side != 0]
        if not len(a) or not len(b):
            return pd.DataFrame([], columns=["key", "links", "a", "b"])
        x, y = (np.frombuffer(b"".join(f["u"])).reshape(len(f), -1) for f in (a, b))
        nodes, weight = b["node"].to_numpy(), b["copies"].to_numpy(np.int64)
        of = {k: i for i, k in enumerate(b["key"])}
        at = np.array([of.get(k, -1) for k in a["key"]])
        out = np.where(at >= 0, a["copies"].to_numpy(np.int64) - 1, 0)
        n_b = len(y)

        def found():
            for s in range(0, len(x), ROWS):
                hit = _linked(x[s:s + ROWS], y, threshold)
                own = at[s:s + ROWS]
                inside = np.flatnonzero(own >= 0)
                hit[inside, own[inside]] = False
                out[s:s + ROWS] += hit @ weight
                i, j = np.nonzero(hit)
                yield n_b + s + i, j
                yield n_b + s + inside, own[inside]

        label = star_edges(n_b + len(x), found())
        every_node = pd.concat([b["node"], a["node"]]).to_numpy()
        tied = np.flatnonzero(label != np.arange(len(label)))
        edges = {(every_node[i], every_node[label[i]]) for i in tied}
        edges = [e for e in edges if e[0] != e[1]]
        some = np.flatnonzero(out)
        return pd.concat([pd.DataFrame({"key": a["key"].to_numpy()[some], "links": out[some]}),
                          pd.DataFrame(edges, columns=["a", "b"])])[["key", "links", "a", "b"]].astype("Int64")

    cols = ["key", "node", "copies", "u", "side", *keys, "i", "j"]
    joined = materialize(left.select(*cols).unionByName(right.select(*cols)).groupBy(*keys, "i", "j").applyInPandas(
        join, "key long, links long, a long, b long"))
    edges = joined.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    classes = connected_components(edges)
    links = joined.where("key IS NOT NULL").groupBy("key").agg(F.sum("links").alias("n_links"))
    known = held.join(links, "key", "left").select("h", "label", "v", "node", "n_links")
    known = known.join(classes.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "h", "label", "v", F.coalesce("component", "node").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    got = rows.join(known, (rows["h"] == known["h"]) & (rows["label"] == known["label"]) & (rows["v"] == known["v"]), "left")
    component = F.coalesce(known["c"], rows["vec_id"])
    return got.select(rows["vec_id"], F.coalesce(known["n_links"], F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), (rows["vec_id"] == component).alias("kept"))
