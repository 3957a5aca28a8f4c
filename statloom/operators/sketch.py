"""Incremental PCA on a frequent-directions sketch (Liberty 2013).

A sketch of ``size`` rows stands for any number of rows: its Gram matrix differs from
theirs by at most (squared Frobenius norm) / (size / 2) in spectral norm.  Each task folds its rows
into a sketch of its own; sketches merge by the same step, so they are folded by a
tree of groups until a few are left, and a table is read once whatever its number of
columns (no p x p matrix is added up).  Rows are standardised first.

Cases: rows with a missing value take no part; fewer rows than ``size`` are held
exactly; an empty table gives no components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.exprs import numeric_columns
from statloom.operators.prepare import complete_cases, standardize

SIZE = 64
#: Sketches that one task folds into one.
FAN_IN = 32


def fold(rows: np.ndarray, size: int) -> np.ndarray:
    """At most ``size`` rows that stand for ``rows``: whenever the buffer is full, squared singular values fall by the middle one."""
    held = np.zeros((0, rows.shape[1]))
    for at in range(0, len(rows), size):
        held = np.concatenate([held, rows[at:at + size]])
        if len(held) > size:
            _, s, v = np.linalg.svd(held, full_matrices=False)
            cut = s[size // 2] ** 2 if len(s) > size // 2 else 0.0
            s = np.sqrt(np.maximum(s * s - cut, 0.0))
            held = (s[:, None] * v)[s > 0][:size]
    return held


def frequent_directions(df: DataFrame, cols: list[str], size: int = SIZE, fan_in: int = FAN_IN) -> np.ndarray:
    """The sketch of all rows of the columns ``cols`` (no missing values), at most ``size`` rows."""
    def first(parts):
        held = np.zeros((0, len(cols)))
        for pdf in parts:
            held = fold(np.concatenate([held, pdf[cols].to_numpy(np.float64)]), size)
        if len(held):
            yield pd.DataFrame({"part": np.zeros(len(held), int), "row": list(held)})

    rows = df.select(*cols).mapInPandas(first, "part long, row array<double>")
    rows = rows.withColumn("part", F.spark_partition_id().cast("long")).checkpoint(eager=True)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        held = fold(np.stack(pdf["row"].tolist()), size)
        return pd.DataFrame({"part": pdf["part"].iloc[0], "row": list(held)})

    while rows.select("part").distinct().count() > fan_in:
        rows = rows.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInPandas(
            merge, "part long, row array<double>").checkpoint(eager=True)
    got = sorted((r.part, r.row) for r in rows.collect())  # at most fan_in sketches
    return fold(np.array([r for _, r in got]), size) if got else np.zeros((0, len(cols)))


def incremental_pca(df: DataFrame, cols: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """``(component, explained_ratio, cumulative, variable, loading)``; ratios are at most a share 2 / ``size`` too low."""
    cols = cols or numeric_columns(df)
    z = standardize(complete_cases(df.select(*cols), cols), cols)
    sketch = frequent_directions(z, cols, size)
    total = z.select([F.sum(F.col(c) * F.col(c)).alias(c) for c in cols]).first() if len(sketch) else None
    rows = []
    if total:
        whole = sum(v or 0.0 for v in total)
        _, s, v = np.linalg.svd(sketch, full_matrices=False)
        cum = 0.0
        for j in range(len(s)):
            sign = -1.0 if v[j, np.abs(v[j]).argmax()] < 0 else 1.0
            ratio = float(s[j] ** 2 / whole) if whole else 0.0
            cum += ratio
            rows += [(j + 1, ratio, cum, c, float(sign * v[j, i])) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "component int, explained_ratio double, cumulative double, variable string, loading double")
