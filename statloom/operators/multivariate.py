"""Multivariate analysis.

Standardisation uses the population std (as the reference's scaler).  The Gram
matrix of the components is one scan in which every task adds up its rows; only
the p x p matrix reaches the driver (p = number of columns).  K-means fits all numbers
of classes and restarts by the same scans.  FAMD (M2) is in :mod:`statloom.operators.factor`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.exprs import numeric_columns
from statloom.operators.factor import famd
from statloom.operators.mixture import added_over_tasks, column_moments, scaled
from statloom.operators.prepare import complete_cases, standardize

__all__ = ["famd", "kmeans_profile", "kmeans_sweep", "pca", "scree", "score_plane"]

K_RANGE = range(2, 11)
RESTARTS = 10
SEED = 42
LOADING_COMPONENTS = 5
SCORE_COMPONENTS = 3
SCORE_ROWS = 100
#: Rows that k-means++ draws its starts from, most rounds, and the movement that ends them.
START_ROWS = 4_096
MAX_ROUNDS = 40
TOLERANCE = 1e-4


def _components(df: DataFrame, cols: list[str], key: str | None):
    """Standardised complete rows, their number, falling eigenvalues of the correlation matrix and its vectors (columns)."""
    keep = [key] if key else []
    z = standardize(complete_cases(df.select(*keep, *cols), cols), cols, keep=keep)
    p = len(cols)
    s = added_over_tasks(z.select(*cols), lambda x: np.concatenate([[len(x)], (x.T @ x).ravel()]))
    n = int(s[0]) if len(s) else 0
    values, vectors = np.linalg.eigh(s[1:].reshape(p, p) / n) if n else (np.zeros(p), np.eye(p))
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    signs = np.where(vectors[np.abs(vectors).argmax(0), np.arange(p)] < 0, -1.0, 1.0)
    return z, n, values, vectors * signs


def _scores(z: DataFrame, cols: list[str], vectors: np.ndarray, k: int, keep: list[str]) -> DataFrame:
    return z.select(*keep, *[sum((F.col(c) * float(vectors[i, j]) for i, c in enumerate(cols)), F.lit(0.0)).alias(f"pc{j + 1}")
                             for j in range(k)])


def pca(df: DataFrame, cols: list[str] | None = None, key: str | None = None, loading_components: int = LOADING_COMPONENTS,
        score_components: int = SCORE_COMPONENTS, score_rows: int | None = SCORE_ROWS) -> dict[str, DataFrame]:
    """M1 (+G3): variance ratios, cumulative, eigenvalues, 95 % count, Kaiser
    count, loadings of the first components and scores of the first rows (None: all).

    Eigenvalue = ratio x p x n / (n - 1) (covariance of population-scaled
    data); signs are fixed so that each component's largest |loading| is
    positive.
    """
    cols = cols or numeric_columns(df)
    keep = [key] if key else []
    p = len(cols)
    z, n, values, comps = _components(df, cols, key)
    ratio = values / values.sum() if values.sum() else values
    spark = df.sparkSession
    cum = np.cumsum(ratio)
    eig = ratio * p * n / (n - 1) if n > 1 else ratio * 0
    var_rows = [(j + 1, float(ratio[j]), float(cum[j]), float(eig[j])) for j in range(len(ratio))]
    variance = spark.createDataFrame(var_rows, "component int, explained_ratio double, cumulative double, eigenvalue double")
    n95 = int(np.argmax(cum >= 0.95 - 1e-12) + 1)
    summary = spark.createDataFrame([(n, p, n95, int((eig > 1).sum()))],
                                    "n long, n_columns int, n_components_95 int, kaiser int")
    load_rows = [(cols[i], j + 1, float(comps[i, j])) for i in range(p) for j in range(min(loading_components, p))]
    loadings = spark.createDataFrame(load_rows, "variable string, component int, loading double")
    scored = _scores(z, cols, comps, min(score_components, p), keep)
    if score_rows is not None:
        scored = (scored.orderBy(key) if key else scored).limit(score_rows)
    return {"pca_variance": variance, "pca_summary": summary, "pca_loadings": loadings,
            "pca_scores": scored}


def score_plane(df: DataFrame, cols: list[str] | None = None, key: str | None = None) -> DataFrame:
    """The first two scores of every complete row."""
    cols = cols or [c for c in numeric_columns(df) if c != key]
    z, _, _, vectors = _components(df, cols, key)
    return _scores(z, cols, vectors, min(2, len(cols)), [key] if key else [])


def scree(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Ratio and cumulative per component."""
    return pca(df, cols)["pca_variance"].select("component", "explained_ratio", "cumulative")


# --- k-means (M3, M4, G5) ---

def _assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of every row and the squared distance to it."""
    d2 = (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T
    home = d2.argmin(1)
    return home, np.maximum(d2[np.arange(len(x)), home], 0.0)


def _class_sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Inertia, then per class rows, sum of squares and sums of the columns."""
    home, d2 = _assigned(x, centres)
    k = len(centres)
    return np.concatenate([[d2.sum()], np.bincount(home, minlength=k), np.bincount(home, (x * x).sum(1), k),
                           *[np.bincount(home, x[:, j], k) for j in range(x.shape[1])]])


def _unpacked(s: np.ndarray, k: int, d: int):
    """Inertia, rows, sums of squares and class sums (k x d) of :func:`_class_sums`."""
    return s[0], s[1:1 + k], s[1 + k:1 + 2 * k], s[1 + 2 * k:].reshape(d, k).T


def _starts(z: DataFrame, cols: list[str], models: list[tuple[int, int]], n: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """k-means++ starts of all models (k, restart), drawn from at most ``START_ROWS`` rows by hash."""
    few = z.select(*cols, F.xxhash64(*cols, F.lit(seed)).alias("_h"))
    if n > 2 * START_ROWS:  # a threshold on the hash leaves about twice the rows before the merge
        few = few.where(F.pmod("_h", F.lit(1 << 40)) < F.lit(int((1 << 40) * 2.0 * START_ROWS / n)))
    x = np.array(few.orderBy("_h", *cols).limit(START_ROWS).drop("_h").collect(), np.float64)
    out = {}
    for k, r in models:
        rng = np.random.default_rng(seed + r)
        centres = x[[rng.integers(len(x))]]
        while len(centres) < k:
            d2 = _assigned(x, centres)[1]
            if not d2.sum() > 0:
                break  # fewer distinct rows than classes
            centres = np.vstack([centres, x[rng.choice(len(x), p=d2 / d2.sum())]])
        out[k, r] = centres
    return out


def lloyd(z: DataFrame, cols: list[str], models: list[tuple[int, int]], n: int, seed: int = SEED):
    """Fitted models (k, restart) -> (inertia, rows, sums of squares, class sums, centres).

    All models move together: one scan a round adds up the class sums of every model that still moves.
    """
    z = z.select(*cols)
    d = len(cols)
    centres = _starts(z, cols, models, n, seed)
    moving = list(models)
    for _ in range(MAX_ROUNDS):
        held = [(m, centres[m]) for m in moving]
        s = added_over_tasks(z, lambda x, held=held: np.concatenate([_class_sums(x, c) for _, c in held]))
        at, still = 0, []
        for m, c in held:
            size = 1 + len(c) * (2 + d)
            _, rows, _, sums = _unpacked(s[at:at + size], len(c), d)
            at += size
            new = np.where(rows[:, None] > 0, sums / np.maximum(rows, 1)[:, None], c)
            centres[m] = new
            if ((new - c) ** 2).sum(1).max() > TOLERANCE ** 2:
                still.append(m)
        moving = still
        if not moving:
            break
    s = added_over_tasks(z, lambda x: np.concatenate([_class_sums(x, centres[m]) for m in models]))
    out, at = {}, 0
    for m in models:
        size = 1 + len(centres[m]) * (2 + d)
        out[m] = (*_unpacked(s[at:at + size], len(centres[m]), d), centres[m])
        at += size
    return out


def _silhouettes(x: np.ndarray, model) -> float:
    """Sum of the rows' silhouettes (squared Euclidean distances, means over whole classes)."""
    _, rows, squares, sums, centres = model
    home, _ = _assigned(x, centres)
    held = np.maximum(rows, 1)
    to = (x * x).sum(1)[:, None] + squares / held - 2 * x @ (sums / held[:, None]).T
    own = to[np.arange(len(x)), home] * rows[home] / np.maximum(rows[home] - 1, 1)
    to[np.arange(len(x)), home] = np.inf
    to[:, rows == 0] = np.inf
    other = to.min(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.where((rows[home] > 1) & np.isfinite(other), (other - own) / np.maximum(other, own), 0.0)
    return float(np.nan_to_num(s).sum())


def kmeans_sweep(df: DataFrame, cols: list[str] | None = None, k_range=K_RANGE,
                 restarts: int = RESTARTS, seed: int = SEED) -> DataFrame:
    """M3 (+G5): inertia and silhouette per k on standardised complete cases.

    Each k keeps the best of ``restarts`` k-means++ starts (lowest inertia); all of them
    are fitted by the same scans.  The silhouette uses squared Euclidean distances
    (documented difference).  k stays below the number of complete rows.
    """
    cols = cols or numeric_columns(df)
    z = scaled(df, cols)
    n = z.count()
    ks = [k for k in k_range if k < n]
    spark = df.sparkSession
    schema = "k int, inertia double, silhouette double"
    if not ks:
        return spark.createDataFrame([], f"{schema}, is_best boolean")
    fitted = lloyd(z, cols, [(k, r) for k in ks for r in range(restarts)], n, seed)
    best = {k: fitted[min(((k, r) for r in range(restarts)), key=lambda m: (fitted[m][0], m))] for k in ks}
    sums = added_over_tasks(z.select(*cols), lambda x: np.array([_silhouettes(x, best[k]) for k in ks]))
    rows = [(k, float(best[k][0]), float(s / n)) for k, s in zip(ks, sums)]
    top = min(rows, key=lambda r: (-r[2], r[0]))[0]
    return spark.createDataFrame([(*r, r[0] == top) for r in rows], f"{schema}, is_best boolean")


def kmeans_profile(df: DataFrame, k: int, cols: list[str] | None = None, restarts: int = RESTARTS,
                   seed: int = SEED) -> DataFrame:
    """M4: cluster sizes and centres in original units for the chosen k, the largest first."""
    cols = cols or numeric_columns(df)
    z = scaled(df, cols)
    n = z.count()
    schema = "cluster int, size long, " + ", ".join(f"`{c}` double" for c in cols)
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    fitted = lloyd(z, cols, [(k, r) for r in range(restarts)], n, seed)
    _, rows, _, sums, _ = fitted[min(fitted, key=lambda m: (fitted[m][0], m))]
    mean, std = column_moments(df, cols)
    found = [(int(c), *(s / c * std + mean).tolist()) for c, s in zip(rows, sums) if c]
    return df.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(sorted(found, key=lambda r: (-r[0], r[1:])))], schema)
