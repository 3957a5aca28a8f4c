"""Factor analysis of categories: correspondence (CA), multiple correspondence (MCA) and mixed data (FAMD).

No indicator columns are made.  The covariance of indicators (level - share) /
sqrt(share) comes from counts: for two levels, rows with both / (n sqrt(share share')) less
the outer product of sqrt(share).  The counts of all pairs of levels are one group-by on
(variable pair, level pair), with as many cells as pairs that occur; a
measure meets a level through the level's mean of the standardised measure.  The largest
eigenpairs are taken over these rows (``functions.spectral``), so a variable may have any
number of levels.

Cases: rows with a missing value take no part; a constant measure has no share; an
empty table gives no components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.components import materialize
from statloom.functions.exprs import string_columns
from statloom.functions.spectral import DENSE, top_eigen
from statloom.operators.prepare import complete_cases, standardize
from statloom.session import ensure_checkpoint_dir

COMPONENTS = 10
#: Fixed value: coordinates that the reference shows.
SCORE_COMPONENTS = 3
SCORE_ROWS = 100


def _node(variable, level=None):
    """An index: the variable, and for a level its value."""
    return F.struct(F.lit(variable).alias("variable"), (F.lit(None) if level is None else level).cast("string").alias("level"))


def _levels(x: DataFrame, cats: list[str]) -> DataFrame:
    """One row per category value of every row, in long form."""
    return x.select("*", F.explode(F.array(*[_node(c, F.col(c)) for c in cats])).alias("i"))


def _pair_counts(x: DataFrame, cats: list[str]) -> DataFrame:
    """(i, j, c): rows with both levels, both ways, for different variables."""
    pairs = [F.struct(_node(a, F.col(a)).alias("i"), _node(b, F.col(b)).alias("j")) for a, b in combinations(cats, 2)]
    one = x.select(F.inline(F.array(*pairs))).groupBy("i", "j").agg(F.count("*").alias("c"))
    return one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "c"))


def mixed_matrix(x: DataFrame, nums: list[str], cats: list[str], n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entries (i, j, a) and nodes (i, u, variance, share) of the covariance of the complete rows ``x``, and x with z-scores.

    Two indices: a measure (variable, null), a level (variable, value).
    """
    z = standardize(x, nums, keep=[c for c in x.columns if c not in nums]) if nums else x
    z = materialize(z)
    means = [F.avg(c).alias(f"m{j}") for j, c in enumerate(nums)]
    lv = materialize(_levels(z, cats).groupBy("i").agg(F.count("*").alias("c"), *means)) if cats else None
    nodes, entries = [], []
    if nums:
        pairs = [(a, b) for a in nums for b in nums]
        r = z.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"s{j}") for j, (a, b) in enumerate(pairs)]).first()
        spark = x.sparkSession
        rows = [((a, None), (b, None), float(r[f"s{j}"]) / n) for j, (a, b) in enumerate(pairs)]
        kind = "struct<variable:string,level:string>"
        entries.append(spark.createDataFrame(rows, f"i {kind}, j {kind}, a double"))
        nodes.append(spark.createDataFrame([((c, None), 0.0, float(r[f"s{j * len(nums) + j}"]) / n, None)
                                            for j, c in enumerate(nums)], f"i {kind}, u double, variance double, share double"))
    if cats:
        share = F.col("c") / F.lit(float(n))
        nodes.append(lv.select("i", F.sqrt(share).alias("u"), (1 - share).alias("variance"), share.alias("share")))
        entries.append(lv.select("i", F.col("i").alias("j"), F.lit(1.0).alias("a")))
        one = lv.select(F.col("i").alias("j"), F.col("c").alias("cj"))
        counts = _pair_counts(z, cats).join(lv.select("i", F.col("c").alias("ci")), "i").join(one, "j") if len(cats) > 1 else None
        if counts is not None:
            entries.append(counts.select("i", "j", (F.col("c") / F.sqrt(F.col("ci").cast("double") * F.col("cj"))).alias("a")))
        if nums:
            cross = lv.select("i", "c", F.inline(F.array(*[F.struct(_node(c).alias("j"), F.col(f"m{j}").alias("m"))
                                                          for j, c in enumerate(nums)])))
            cross = cross.select("i", "j", (F.sqrt(F.col("c") / F.lit(float(n))) * F.col("m")).alias("a"))
            entries += [cross, cross.select(F.col("j").alias("i"), F.col("i").alias("j"), "a")]
    every = entries[0]
    for e in entries[1:]:
        every = every.unionByName(e)
    all_nodes = nodes[0]
    for m in nodes[1:]:
        all_nodes = all_nodes.unionByName(m)
    return materialize(every), materialize(all_nodes), z


def _table(spark, values: np.ndarray, total: float) -> DataFrame:
    share = values / total if total else values * 0
    cum = np.cumsum(share)
    return spark.createDataFrame([(j + 1, float(values[j]), float(share[j]), float(cum[j])) for j in range(len(values))],
                                 "component int, eigenvalue double, inertia double, cumulative double")


def famd(df: DataFrame, num_cols: list[str], cat_cols: list[str], n_components: int = COMPONENTS, key: str | None = None,
         score_components: int = SCORE_COMPONENTS, score_rows: int | None = SCORE_ROWS, dense: int = DENSE) -> dict[str, DataFrame]:
    """M2: PCA of z-scores and indicators (level - share) / sqrt(share) (Pages 2004), by counts.

    ``famd_inertia``: share and cumulative per component; ``famd_rows``: coordinates of the first
    ``score_rows`` rows by ``key`` (None: of all rows); ``famd_columns``: correlation of
    every measure and level with the first ``score_components`` components.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    keep = [key] if key else []
    x = complete_cases(df.select(*dict.fromkeys([*keep, *num_cols, *cat_cols])), num_cols + cat_cols)
    n = x.count()
    empty = {"famd_inertia": _table(spark, np.zeros(0), 0).drop("eigenvalue"),
             "famd_rows": x.select(*keep).limit(0), "famd_columns": spark.createDataFrame(
                 [], "variable string, level string, component string, correlation double")}
    if not n:
        return empty
    entries, nodes, z = mixed_matrix(x, num_cols, cat_cols, n)
    total = nodes.agg(F.sum("variance")).first()[0]
    wanted = min(n_components, len(num_cols) + len(cat_cols), nodes.count())
    values, vectors = top_eigen(entries, nodes, max(wanted, score_components), dense)
    inertia = _table(spark, values[:wanted], total).drop("eigenvalue")
    kk = min(score_components, len(values))
    vectors = materialize(vectors)
    # a component's variance is its eigenvalue, so its covariance with a column is that times the vector's entry
    roots = F.array(*[F.lit(float(np.sqrt(max(v, 0.0)))) for v in values[:kk]])
    columns = vectors.join(nodes.select("i", "variance"), "i").select(
        "i", "variance", F.posexplode(F.zip_with(F.slice("vec", 1, kk), roots, lambda a, b: a * b)).alias("p", "c"))
    columns = columns.select(F.col("i.variable").alias("variable"), F.col("i.level").alias("level"),
                             F.concat(F.lit("dim"), (F.col("p") + 1).cast("string")).alias("component"),
                             F.try_divide("c", F.sqrt(F.when(F.col("variance") > 1e-12, F.col("variance")))).alias("correlation"))
    shown = z if score_rows is None else (z.orderBy(key) if key else z).limit(score_rows)
    return {"famd_inertia": inertia, "famd_columns": columns,
            "famd_rows": _row_scores(shown, vectors, nodes, num_cols, cat_cols, kk, keep)}


def _row_scores(z: DataFrame, vectors: DataFrame, nodes: DataFrame, nums: list[str], cats: list[str], kk: int,
                keep: list[str]) -> DataFrame:
    """Coordinates dim1.. of rows: the sum of their entries times the vectors, per column."""
    parts = {tuple(r.i)[0]: r.vec for r in vectors.where("i.level IS NULL").collect()}  # one per measure
    out = z
    for d in range(kk):
        fixed = F.lit(0.0)
        for c in nums:
            fixed = fixed + F.col(c) * F.lit(float(parts[c][d]))
        out = out.withColumn(f"dim{d + 1}", fixed)
    # an indicator is -sqrt(share) everywhere, and 1 / sqrt(share) more where the level is the row's
    weights = vectors.where("i.level IS NOT NULL").join(nodes.select("i", "share"), "i") if cats else None
    for j, c in enumerate(cats):
        own = weights.where(F.col("i.variable") == c)
        base = own.agg(*[F.sum(F.sqrt("share") * F.get("vec", F.lit(d))).alias(f"b{d}") for d in range(kk)]).first()
        own = own.select(F.col("i.level").alias(f"_l{j}"), *[(F.get("vec", F.lit(d)) / F.sqrt("share")).alias(f"_g{j}_{d}")
                                                           for d in range(kk)])
        out = out.join(own, F.col(c).cast("string") == F.col(f"_l{j}"), "left")
        for d in range(kk):
            out = out.withColumn(f"dim{d + 1}", F.col(f"dim{d + 1}") + F.col(f"_g{j}_{d}") - F.lit(float(base[d] or 0.0)))
    return out.select(*keep, *[f"dim{d + 1}" for d in range(kk)])


def mca(df: DataFrame, cat_cols: list[str] | None = None, n_components: int = COMPONENTS, dense: int = DENSE) -> dict[str, DataFrame]:
    """``mca_inertia`` (component, eigenvalue, inertia, cumulative) and ``mca_levels`` (variable, level, share, component, coordinate).

    Eigenvalues are those of the indicator matrix; coordinates of levels are principal.
    """
    cat_cols = cat_cols or string_columns(df)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    x = complete_cases(df.select(*cat_cols), cat_cols)
    n, q = x.count(), len(cat_cols)
    if not n:
        return {"mca_inertia": _table(spark, np.zeros(0), 0), "mca_levels": spark.createDataFrame(
            [], "variable string, level string, share double, component int, coordinate double")}
    entries, nodes, _ = mixed_matrix(x, [], cat_cols, n)
    total = nodes.agg(F.sum("variance")).first()[0] / q
    values, vectors = top_eigen(entries, nodes, min(n_components, nodes.count()), dense)
    values = values / q
    keep = values > 1e-10
    scale = F.array(*[F.lit(float(np.sqrt(max(v, 0.0) * q))) for v in values])
    lv = vectors.join(nodes, "i").select("i", "share", F.posexplode(F.zip_with(
        "vec", scale, lambda a, s: a * s / F.sqrt("share"))).alias("p", "coordinate")).where(F.col("p") < int(keep.sum()))
    return {"mca_inertia": _table(spark, values[keep], total),
            "mca_levels": lv.select(F.col("i.variable").alias("variable"), F.col("i.level").alias("level"), "share",
                                    (F.col("p") + 1).alias("component"), "coordinate")}


def ca(df: DataFrame, row: str, column: str, n_components: int = COMPONENTS, dense: int = DENSE) -> dict[str, DataFrame]:
    """Correspondence analysis of the table of two columns: ``ca_inertia`` and ``ca_points``, principal coordinates of both.

    The two-way residuals are the off-diagonal block of a symmetric matrix, whose positive
    eigenvalues are the singular values.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    x = complete_cases(df.select(row, column), [row, column])
    cells = materialize(x.groupBy(F.col(row).cast("string").alias("r"), F.col(column).cast("string").alias("k")).agg(F.count("*").alias("c")))
    n = cells.agg(F.sum("c")).first()[0] or 0
    ends = {"r": row, "k": column}
    margins = {e: cells.groupBy(e).agg(F.sum("c").alias(f"c{e}")) for e in ends}
    per = cells.join(margins["r"], "r").join(margins["k"], "k")
    a = (F.col("c") / F.sqrt(F.col("cr").cast("double") * F.col("ck"))).alias("a")
    # the trivial pair (1, sqrt of shares over both sides) is taken off; its mirror image lies at -1
    one = per.select(_node("row", F.col("r")).alias("i"), _node("column", F.col("k")).alias("j"), a)
    entries = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "a"))
    nodes = None
    for e, name in (("r", "row"), ("k", "column")):
        own = margins[e].select(_node(name, F.col(e)).alias("i"), F.sqrt(F.col(f"c{e}") / F.lit(2.0 * (n or 1))).alias("u"),
                                (F.col(f"c{e}") / F.lit(float(n or 1))).alias("share"))
        nodes = own if nodes is None else nodes.unionByName(own)
    nodes, entries = materialize(nodes), materialize(entries)
    chi = entries.where("i.variable = 'row'").agg(F.sum(F.col("a") * F.col("a"))).first()[0]
    total = max((chi or 1.0) - 1.0, 0.0)
    side = min((margins[e].count() for e in ends), default=0)
    values, vectors = top_eigen(entries, nodes.select("i", "u"), max(0, min(n_components, side - 1)), dense)
    keep = values > 1e-7
    scale = F.array(*[F.lit(float(v) * float(np.sqrt(2.0))) for v in values]).cast("array<double>")
    pts = vectors.join(nodes, "i").select("i", "share", F.posexplode(F.zip_with(
        "vec", scale, lambda a, s: a * s / F.sqrt("share"))).alias("p", "coordinate")).where(F.col("p") < int(keep.sum()))
    return {"ca_inertia": _table(spark, values[keep] ** 2, total),
            "ca_points": pts.select(F.col("i.variable").alias("side"), F.col("i.level").alias("level"), "share",
                                    (F.col("p") + 1).alias("component"), "coordinate")}
