"""Gaussian mixtures by expectation-maximisation with full covariances.

Every round is one scan of the standardised complete cases: each task turns its
rows into log-sum-exp responsibilities and returns only the sums that the next
parameters need (weight, first and second moments per component, and the log
likelihood).  Those sums are a few numbers per component whatever the table
holds; Spark adds them up per slot and the driver takes the next step.  The
starting point is Spark's k-means++-seeded k-means.

Cases: rows with a missing value take no part; a constant column stays at zero;
fewer distinct rows than components leave empty components at weight zero; an
empty table gives no components.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.exprs import numeric_columns
from statloom.operators.prepare import complete_cases, standardize
from statloom.session import ensure_checkpoint_dir

K_RANGE = range(1, 7)
MAX_ROUNDS = 200
#: EM ends when the mean log likelihood gains less than this.
TOLERANCE = 1e-5
#: Added to the diagonal of every covariance, so that no component collapses on a point.
RIDGE = 1e-6
SEED = 42


@dataclass
class Mixture:
    """Parameters in standardised units; ``history`` holds the mean log likelihood of every round."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    history: list[float]
    n: int

    @property
    def parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * d * (d + 1) // 2


def log_joint(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covariances: np.ndarray) -> np.ndarray:
    """log(weight x density) of every row and component."""
    out = np.full((len(x), len(weights)), -np.inf)
    for j in np.flatnonzero(weights > 0):
        low = np.linalg.cholesky(covariances[j])
        z = (x - means[j]) @ np.linalg.solve(low, np.eye(len(low))).T
        out[:, j] = (math.log(weights[j]) - np.einsum("nd,nd->n", z, z) / 2 - np.log(np.diag(low)).sum()
                     - x.shape[1] / 2 * math.log(2 * math.pi))
    return out


def responsibilities(x: np.ndarray, weights, means, covariances) -> tuple[np.ndarray, np.ndarray]:
    """Responsibilities and log densities of the rows."""
    lj = log_joint(x, weights, means, covariances)
    top = lj.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(lj - top).sum(1))
    return np.exp(lj - total[:, None]), total


def sums(x: np.ndarray, r: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log likelihood, then per component weight, first and second moments, in one row of numbers."""
    second = [(r[:, j, None] * x).T @ x for j in range(r.shape[1])]
    return np.concatenate([[total.sum()], r.sum(0), (r.T @ x).ravel(), np.ravel(second)])


def maximise(s: np.ndarray, k: int, d: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters from the sums; a component without weight keeps weight zero."""
    w = s[1:1 + k]
    held = np.where(w > 1e-12 * n, w, 1.0)
    means = s[1 + k:1 + k + k * d].reshape(k, d) / held[:, None]
    second = s[1 + k + k * d:].reshape(k, d, d) / held[:, None, None]
    cov = second - np.einsum("ki,kj->kij", means, means) + RIDGE * np.eye(d)
    cov = (cov + cov.transpose(0, 2, 1)) / 2
    for j in range(k):  # rounding may leave a covariance of few points indefinite
        low = np.linalg.eigvalsh(cov[j])[0]
        if low < RIDGE / 2:
            cov[j] += (RIDGE - low) * np.eye(d)
    return np.where(w > 1e-12 * n, w, 0.0) / n, means, cov


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.to_numpy(np.float64)


def added_over_tasks(z: DataFrame, task) -> np.ndarray:
    """The sum over all tasks of ``task(rows)``, an array of the same few numbers everywhere."""
    def run(parts):
        got = None
        for pdf in parts:
            if len(pdf):
                s = task(_matrix(pdf))
                got = s if got is None else got + s
        if got is not None:
            yield pd.DataFrame({"slot": np.arange(len(got)), "value": got})

    added = z.mapInPandas(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value"))
    return np.array([r.value for r in sorted(added.collect())])


def scaled(df: DataFrame, cols: list[str], keep: list[str] | None = None) -> DataFrame:
    """Standardised complete cases, written once: every round reads them again."""
    ensure_checkpoint_dir(df.sparkSession)
    x = complete_cases(df.select(*(keep or []), *cols), cols)
    return standardize(x, cols, keep=keep or []).checkpoint(eager=True)


def start_of(z: DataFrame, cols: list[str], k: int, n: int, seed: int = SEED):
    """Parameters of the hard classes of k-means."""
    centres = np.zeros((1, len(cols)))
    if k > 1:
        vec = VectorAssembler(inputCols=cols, outputCol="features").transform(z)
        centres = np.array(KMeans(k=k, seed=seed, featuresCol="features").fit(vec).clusterCenters())
    centres = np.concatenate([centres, np.full((k - len(centres), len(cols)), np.inf)])

    def hard(x):
        r = np.zeros((len(x), k))
        r[np.arange(len(x)), ((x[:, None] - centres) ** 2).sum(2).argmin(1)] = 1.0
        return sums(x, r, np.zeros(len(x)))

    return maximise(added_over_tasks(z, hard), k, len(cols), n)


def fit(z: DataFrame, cols: list[str], k: int, start=None, max_rounds: int = MAX_ROUNDS,
        tolerance: float = TOLERANCE, seed: int = SEED) -> Mixture:
    """EM on the standardised columns ``cols`` of ``z`` (see :func:`scaled`) from ``start`` (weights, means, covariances)."""
    z = z.select(*cols)
    n, d = z.count(), len(cols)
    if not n:
        return Mixture(np.zeros(0), np.zeros((0, d)), np.zeros((0, d, d)), [], 0)
    now = start or start_of(z, cols, k, n, seed)
    k = len(now[0])
    history: list[float] = []
    while True:
        def step(x, at=now):
            return sums(x, *responsibilities(x, *at))

        s = added_over_tasks(z, step)
        history.append(s[0] / n)
        if len(history) > max_rounds or len(history) > 1 and history[-1] - history[-2] < tolerance:
            return Mixture(*now, history, n)
        now = maximise(s, k, d, n)


def column_moments(df: DataFrame, cols: list[str]):
    """Mean and population standard deviation of the complete cases."""
    r = complete_cases(df.select(*cols), cols).agg(
        *[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return np.array([r[f"m_{c}"] or 0.0 for c in cols]), np.array([r[f"s_{c}"] or 0.0 for c in cols])


def gmm_components(df: DataFrame, k: int, cols: list[str] | None = None, **options) -> DataFrame:
    """``(component, weight, variable, mean, std)`` in the table's units, components by falling weight."""
    cols = cols or numeric_columns(df)
    m = fit(scaled(df, cols), cols, k, **options)
    mean, std = column_moments(df, cols)
    order = sorted(range(len(m.weights)), key=lambda j: (-m.weights[j], m.means[j].tolist()))
    rows = [(i + 1, float(m.weights[j]), c, float(m.means[j, a] * std[a] + mean[a]),
             float(math.sqrt(m.covariances[j, a, a]) * std[a]))
            for i, j in enumerate(order) for a, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "component int, weight double, variable string, mean double, std double")


def gmm_sweep(df: DataFrame, cols: list[str] | None = None, k_range=K_RANGE, **options) -> DataFrame:
    """``(k, rounds, log_likelihood, bic, aic, is_best)``: the smallest BIC is best."""
    cols = cols or numeric_columns(df)
    z = scaled(df, cols)
    rows = []
    for k in k_range:
        m = fit(z, cols, k, **options)
        if m.n:
            total = float(m.history[-1] * m.n)
            rows.append((k, len(m.history), total, m.parameters * math.log(m.n) - 2 * total, 2 * m.parameters - 2 * total))
    best = min(rows, key=lambda r: (r[3], r[0]))[0] if rows else None
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows],
                                           "k int, rounds int, log_likelihood double, bic double, aic double, is_best boolean")


def gmm_labels(df: DataFrame, key: str, k: int, cols: list[str] | None = None, **options) -> DataFrame:
    """``(key, component, responsibility, log_density)`` of every complete row; components as in :func:`gmm_components`."""
    cols = cols or [c for c in numeric_columns(df) if c != key]
    z = scaled(df, cols, [key])
    m = fit(z, cols, k, **options)
    order = np.array(sorted(range(len(m.weights)), key=lambda j: (-m.weights[j], m.means[j].tolist())), int)
    at = (m.weights[order], m.means[order], m.covariances[order])

    def label(parts):
        for pdf in parts:
            if len(pdf):
                r, total = responsibilities(_matrix(pdf[cols]), *at)
                top = r.argmax(1)
                yield pd.DataFrame({key: pdf[key], "component": top + 1, "responsibility": r[np.arange(len(r)), top],
                                    "log_density": total})

    kind = dict(z.dtypes)[key]
    return z.mapInPandas(label, f"`{key}` {kind}, component int, responsibility double, log_density double")
