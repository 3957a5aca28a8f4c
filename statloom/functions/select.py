"""Exact quantiles by distributed selection (no shuffle of the values).

Round 1 brackets every target rank with ``percentile_approx`` (mergeable
Greenwald-Khanna summaries; rank error at most ``n / accuracy``) taken at
``q +- 3 / accuracy``.  A count pass verifies each bracket exactly
(``#(x < L) <= k < #(x <= U)``) and fixes the rank offset; a failed side
falls back to the previous, valid bound.  Brackets still holding more than
``collect_limit`` values are refined again inside the bracket; the rest are
resolved from the value counts inside the bracket (at most ``collect_limit``
distinct values per target).  Every step is a small aggregate over one scan,
so the cost is a few column scans whatever the data size (about three rounds
at 10^12 rows with the default accuracy).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.exprs import clean_numeric
from statloom.session import ensure_parallelism

ACCURACY = 10_000
COLLECT_LIMIT = 50_000


def _in(c, L, U):
    cond = F.col(c).isNotNull()
    if L is not None:
        cond = cond & (F.col(c) >= F.lit(L))
    if U is not None:
        cond = cond & (F.col(c) <= F.lit(U))
    return cond


def _bucket(x, t, a, b):
    """Number of thresholds ``t[a:b]`` that are <= x, plus ``a`` (balanced CASE tree)."""
    if a == b:
        return F.lit(a)
    mid = (a + b) // 2
    return F.when(x < F.lit(t[mid]), _bucket(x, t, a, mid)).otherwise(_bucket(x, t, mid + 1, b))


def _counts_below(x: DataFrame, cols: list[str], thresholds: dict[int, list[float]]) -> dict:
    """``{(col index, t): #(x < t)}`` for every threshold, in one scan.

    Each value is bucketed by binary search over its column's sorted
    thresholds; one small aggregate counts the buckets.
    """
    items = [(i, sorted(set(ts))) for i, ts in thresholds.items() if ts]
    if not items:
        return {}
    vals = [F.col(cols[i]) for i, _ in items]
    cols_b = [F.struct(F.lit(i).alias("ci"),
                       F.when(v.isNotNull(), _bucket(v, ts, 0, len(ts))).alias("bk"), v.alias("v"))
              for (i, ts), v in zip(items, vals)]
    got = (x.select(F.inline(F.array(*cols_b))).filter(F.col("bk").isNotNull())
           .groupBy("ci", "bk").agg(F.count(F.lit(1)).alias("n"),
                                    F.approx_count_distinct("v").alias("d")).collect())
    hist, dist = {}, {}
    for r in got:
        hist.setdefault(r["ci"], {})[r["bk"]] = r["n"]
        dist.setdefault(r["ci"], {})[r["bk"]] = r["d"]
    out = {}
    for i, ts in items:
        h, dd = hist.get(i, {}), dist.get(i, {})
        run, drun = 0, 0
        for j, t in enumerate(ts):
            run += h.get(j, 0)           # values with exactly j thresholds <= x are < t_j
            drun += dd.get(j, 0)
            out[(i, t)] = run
            out[("d", i, t)] = drun      # distinct values below t (HLL estimate, summed)
    return out


def _values_inside(x: DataFrame, cols: list[str], brackets: dict[int, list[tuple]]) -> DataFrame:
    """``(ci, value, cnt)``: the values that lie in a bracket ``[L, U]`` of their column (None: open), with their rows.

    A batch is searched at once: as one expression the brackets of all columns
    are a method too large for the JVM's compiler.
    """
    of = {i: (np.sort([-np.inf if lo is None else lo for lo, _ in b]), np.sort([np.inf if hi is None else hi for _, hi in b]))
          for i, b in brackets.items()}

    def inside(it):
        for pdf in it:
            for i, (low, high) in of.items():
                v = pdf[cols[i]].to_numpy(np.float64)
                v = v[~np.isnan(v)] + 0.0  # a null is NaN here; -0.0 is 0.0
                # brackets that begin at or before a value, less those that end before it
                v = v[np.searchsorted(low, v, "right") > np.searchsorted(high, v, "left")]
                if len(v):
                    value, cnt = np.unique(v, return_counts=True)
                    yield pd.DataFrame({"ci": np.full(len(value), i, np.int32), "value": value, "cnt": cnt.astype(np.int64)})

    found = x.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInPandas(inside, "ci int, value double, cnt long")
    return found.groupBy("ci", "value").agg(F.sum("cnt").alias("cnt"))


def exact_quantiles_select(df: DataFrame, cols: list[str], probs: list[float],
                           accuracy: int = ACCURACY, collect_limit: int = COLLECT_LIMIT
                           ) -> DataFrame:
    """``(column_name, prob, q)`` with linear interpolation between order statistics."""
    spark = df.sparkSession
    # the passes below only count and compare exact values, so a round-robin
    # spread and a cached projection cannot change the result
    x = clean_numeric(ensure_parallelism(df), cols).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _select(spark, x, cols, probs, accuracy, collect_limit)
    finally:
        x.unpersist()


def _select(spark, x, cols, probs, accuracy, collect_limit):
    eps = 3.0 / accuracy
    fr = sorted({min(1.0, max(0.0, p + d)) for p in probs for d in (-eps, eps)})
    r0 = x.agg(*[a for i, c in enumerate(cols) for a in (
        F.count(c).alias(f"n{i}"),
        F.percentile_approx(c, fr, accuracy).alias(f"a{i}"))]).first()
    targets = {}  # (col index, k) -> state; bracket [L, U] holds m values, `below` under L
    for i, c in enumerate(cols):
        n = r0[f"n{i}"]
        if not n:
            continue
        approx = dict(zip(fr, r0[f"a{i}"]))
        for p in probs:
            h = (n - 1) * p
            for k in {math.floor(h), math.ceil(h)}:
                cand = (approx[min(1.0, max(0.0, p - eps))], approx[min(1.0, max(0.0, p + eps))])
                targets[(i, k)] = {"L": None, "U": None, "below": 0, "upto": n, "m": n,
                                   "cand": cand if n > collect_limit else None}
    while True:  # until every bracket is small or can shrink no further
        pending = [t for t, st in targets.items() if st["cand"] is not None]
        if not pending:
            break
        th = {}
        for t in pending:
            lo, hi = targets[t]["cand"]
            th.setdefault(t[0], []).extend([lo, math.nextafter(hi, math.inf)])
        cnt = _counts_below(x, cols, th)
        refine = []
        for t in pending:
            st = targets[t]
            lo, hi = st["cand"]
            below, upto = cnt[(t[0], lo)], cnt[(t[0], math.nextafter(hi, math.inf))]
            k = t[1]
            if below <= k:                 # otherwise keep the previous (valid) lower bound
                st["L"], st["below"] = lo, below
            if upto > k:                   # otherwise keep the previous (valid) upper bound
                st["U"], st["upto"] = hi, upto
            st["m"] = st["upto"] - st["below"]
            st["cand"] = None
            # resolve from value counts when the bracket holds few *distinct* values,
            # however many rows tie on them
            if st["L"] is not None and st["U"] is not None:
                d_in = (cnt[("d", t[0], math.nextafter(st["U"], math.inf))]
                        - cnt[("d", t[0], st["L"])]) if (t[0], st["L"]) in cnt and \
                    (t[0], math.nextafter(st["U"], math.inf)) in cnt else st["m"]
            else:
                d_in = st["m"]
            if st["m"] > collect_limit and d_in > collect_limit // 2:
                refine.append(t)
        if not refine:
            break
        aggs = []
        for j, t in enumerate(refine):
            st = targets[t]
            c = cols[t[0]]
            q = (t[1] - st["below"]) / max(1, st["m"])
            qs = [min(1.0, max(0.0, q - eps)), min(1.0, max(0.0, q + eps))]
            aggs.append(F.percentile_approx(F.when(_in(c, st["L"], st["U"]), F.col(c)), qs,
                                            accuracy).alias(f"a{j}"))
        r = x.agg(*aggs).first()
        for j, t in enumerate(refine):
            cand = tuple(r[f"a{j}"])
            st = targets[t]
            # no progress (the bracket is made of a few heavily tied values): stop refining
            targets[t]["cand"] = None if cand == (st["L"], st["U"]) else cand
    # final: value counts inside every bracket, resolved on the driver (bounded)
    by_col = {}
    for t, s in targets.items():
        by_col.setdefault(t[0], []).append(s)
    cells = {}
    for row in _values_inside(x, cols, {i: [(st["L"], st["U"]) for st in ss] for i, ss in by_col.items()}).collect():
        cells.setdefault(row["ci"], []).append((row["value"], row["cnt"]))  # bounded: distinct values inside the brackets
    for v in cells.values():
        v.sort()

    def kth(i, k):
        s = targets[(i, k)]
        pos = k - s["below"]
        for v, cnt in cells.get(i, []):
            if s["L"] is not None and v < s["L"]:
                continue
            if s["U"] is not None and v > s["U"]:
                break
            if pos < cnt:
                return v
            pos -= cnt
        raise RuntimeError("exact selection lost its bracket")

    rows = []
    for i, c in enumerate(cols):
        n = r0[f"n{i}"]
        for p in probs:
            if not n:
                rows.append((c, float(p), None))
                continue
            h = (n - 1) * p
            lo, hi = kth(i, math.floor(h)), kth(i, math.ceil(h))
            rows.append((c, float(p), lo + (hi - lo) * (h - math.floor(h))))
    return spark.createDataFrame(rows, "column_name string, prob double, q double")
