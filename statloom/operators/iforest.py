"""Isolation forest (O3), Liu, Ting and Zhou (2008).

Training rows: a pool of at most ``trees x sample`` complete-case rows, chosen
by a seeded hash order (a distributed top-n, bounded), from which each tree
takes the ``sample`` rows with the smallest per-tree hash (so small tables
reuse rows across trees, large ones give disjoint subsamples).  Trees are
grown in one grouped pandas task each; the node table (at most
``trees x (2 x sample - 1)`` rows) is broadcast and every row of the table is
scored in Arrow batches.  The outlier threshold is the exact
``contamination`` quantile of the scores (distributed quantile primitive).
Scores follow the reference's sign: ``-2^(-E[h] / c(sample))``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.exprs import numeric_columns
from statloom.functions.ranks import exact_quantiles
from statloom.operators.prepare import complete_cases
from statloom.session import ensure_parallelism

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.1
SEED = 42
FIRST_SCORES = 100
_EULER = 0.5772156649

NODE_SCHEMA = ("tree_id int, node int, feature int, threshold double, left int, right int, "
               "size long, depth int")


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    nodes = []

    def build(idx, depth):
        me = len(nodes)
        nodes.append([me, -1, 0.0, -1, -1, len(idx), depth])
        if depth >= max_depth or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        ok = np.flatnonzero(hi > lo)
        if len(ok) == 0:
            return me
        f = int(rng.choice(ok))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[me][1], nodes[me][2] = f, t
        nodes[me][3] = build(left, depth + 1)
        nodes[me][4] = build(right, depth + 1)
        return me

    build(np.arange(len(x)), 0)
    return nodes


def _fit_group(cols, sample, seed):
    max_depth = int(math.ceil(math.log2(max(sample, 2))))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree_id"].iloc[0])
        x = pdf.sort_values("_h")[cols].to_numpy(float)
        rng = np.random.default_rng(seed + tid)
        nodes = _grow(x, rng, max_depth)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        out.insert(0, "tree_id", tid)
        return out
    return fit


def _path_lengths(x: np.ndarray, tree: dict) -> np.ndarray:
    """Path length of every row; ``x`` holds the rows one behind the other, a leaf leads to itself."""
    node = np.zeros(len(x), dtype=np.intp)
    flat, base = x.ravel(), np.arange(len(x), dtype=np.intp) * x.shape[1]
    for _ in range(tree["levels"]):
        right = ~(flat.take(base + tree["feature"].take(node)) < tree["threshold"].take(node))
        node = tree["child"].take(2 * node + right)
    return tree["path"].take(node)


def _tree(g: pd.DataFrame) -> dict:
    """A tree's nodes, in order, as arrays; ``child`` holds every node's left and right one."""
    leaf, me = g["feature"].to_numpy() < 0, np.arange(len(g))
    child = np.stack([np.where(leaf, me, g[c].to_numpy()) for c in ("left", "right")], 1).ravel().astype(np.intp)
    return {"feature": np.where(leaf, 0, g["feature"].to_numpy()).astype(np.intp), "threshold": g["threshold"].to_numpy(),
            "child": child, "levels": int(g["depth"].max()),
            "path": g["depth"].to_numpy() + np.array([c_factor(s) for s in g["size"]])}


def isolation_scores(df: DataFrame, key: str, cols: list[str] | None = None, trees: int = TREES,
                     sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """``(key, score)`` for every complete-case row (score = -anomaly score)."""
    cols = cols or [c for c in numeric_columns(df) if c != key]
    spark = df.sparkSession
    x = complete_cases(df.select(key, *[F.col(c).cast("double").alias(c) for c in cols]), cols)
    h = F.xxhash64(F.lit(seed), F.col(key))
    rows = x.count()
    pool = x.withColumn("_ph", h)
    if rows > 4 * trees * sample:  # a threshold on the hash leaves about twice the pool before the merge
        pool = pool.where(F.pmod("_ph", F.lit(1 << 40)) < F.lit(int((1 << 40) * 2.0 * trees * sample / rows)))
    pool = pool.orderBy("_ph", key).limit(trees * sample)  # bounded top-n
    # every pooled row is a candidate for every tree (pool x trees rows, bounded)
    cand = pool.withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn(
        "_h", F.xxhash64(F.lit(seed), F.col("tree_id"), F.col(key)))
    w = Window.partitionBy("tree_id").orderBy("_h", key)
    # the pool is one partition: a fixed number of parts keeps the trees from being grown in one task
    cand = cand.repartition(min(trees, spark.sparkContext.defaultParallelism), "tree_id")
    train = cand.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample)
    nodes = (train.select("tree_id", "_h", *cols).groupBy("tree_id")
             .applyInPandas(_fit_group(cols, sample, seed), NODE_SCHEMA)).toPandas()
    forest = [_tree(g.sort_values("node")) for _, g in nodes.groupby("tree_id")]
    bc = spark.sparkContext.broadcast(forest)
    cn = c_factor(min(sample, max(2, rows)))

    def score(it):
        trees_ = bc.value
        for pdf in it:
            arr = np.ascontiguousarray(pdf[cols].to_numpy(float))
            if len(arr) == 0:
                continue
            mean_h = np.mean([_path_lengths(arr, t) for t in trees_], axis=0)
            yield pd.DataFrame({key: pdf[key].to_numpy(), "score": -np.power(2.0, -mean_h / cn)})

    key_type = dict(x.dtypes)[key]
    return ensure_parallelism(x.select(key, *cols)).mapInPandas(score, f"{key} {key_type}, score double")


def outliers_isolation_forest(df: DataFrame, key: str, cols: list[str] | None = None,
                              contamination: float = CONTAMINATION, trees: int = TREES,
                              sample: int = SAMPLE, seed: int = SEED) -> dict[str, DataFrame]:
    """O3: outlier count and share, threshold, and the first 100 scores by key."""
    sc = isolation_scores(df, key, cols, trees, sample, seed).checkpoint(eager=True)
    found = exact_quantiles(sc, ["score"], [contamination]).first()
    if found is None:
        raise ValueError("isolation forest: no row has all columns")
    thr = found["q"]
    summary = sc.agg(F.count(F.lit(1)).alias("n"),
                     F.sum((F.col("score") < F.lit(thr)).cast("long")).alias("n_outliers")).select(
        "n", "n_outliers", (F.col("n_outliers") * 100.0 / F.col("n")).alias("pct"),
        F.lit(thr).alias("threshold"))
    first = sc.orderBy(key).limit(FIRST_SCORES)
    return {"summary": summary, "scores": first}
