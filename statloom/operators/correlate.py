"""Correlation family.

Pearson correlations are computed from pairwise-complete *shifted* sums: pass
1 takes each column's mean, pass 2 sums ``(a - ma)``, ``(b - mb)``, their
squares and cross product over rows where both are present.  Plain sums are
fully code-generated and merge map-side; the shift keeps the cancellation
small, so the result equals a two-pass textbook computation.  Spearman feeds
average ranks (distributed, see ``ranks``) to the same routine.  Kendall's
tau-b counts concordance without forming pairs (see :func:`corr_kendall`).
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.components import materialize
from statloom.functions.exprs import clean_numeric, nan_to_null, numeric_columns, stack_long
from statloom.functions.ranks import ranked_cells
from statloom.functions.special import t_pvalue_udf
from statloom.operators.encode import join_levels

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (correlation screening).
DATE_LIKE = ["_year", "_month", "_day", "_dayofweek", "_quarter", "_is_weekend", "_days_since",
             "date", "data", "time", "tempo", "timestamp", "datetime"]
ID_LIKE = ["id", "index", "key", "chiave", "code", "codice", "_encoded"]
MAX_UNIQUE_RATIO = 0.95
TARGET_WORDS = ["revenue", "ricavo", "entrate", "sales", "vendite", "profit", "profitto", "outcome",
                "risultato", "target", "score", "punteggio", "amount", "importo", "total", "totale",
                "price", "prezzo"]
SIG_MIN, SIG_MAX, SIG_ALPHA, SIG_TOP = 0.3, 0.99, 0.05, 20
TARGET_MIN, TARGET_TOP = 0.2, 10
# ---------------------------------------------------------------------------
#: Distinct values up to which a column's ranks are broadcast.
BROADCAST_CELLS = 100_000


def near_unique(df: DataFrame, cols: list[str], ratio: float) -> list[str]:
    """Columns with more than ``ratio`` distinct values a row.

    A HyperLogLog pass decides columns far below; only those that its error (2 %, taken
    sevenfold) leaves open are counted exactly, which shuffles their values.
    """
    x = nan_to_null(df.select(*cols))
    r = x.agg(F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    close = [c for i, c in enumerate(cols) if r[f"d{i}"] > 0.86 * ratio * r["_rows"]]
    if not close:
        return []
    exact = x.agg(*[F.countDistinct(c).alias(f"d{i}") for i, c in enumerate(close)]).first()
    return [c for i, c in enumerate(close) if exact[f"d{i}"] > r["_rows"] * ratio]


def corr_columns(df: DataFrame, cols: list[str] | None = None,
                 exclude_name_patterns: tuple[list[str], list[str]] | None = None,
                 max_unique_ratio: float | None = MAX_UNIQUE_RATIO) -> DataFrame:
    """``(ordinal, column_name, kept, reason)`` for the numeric columns."""
    cols = cols or numeric_columns(df)
    date_like, id_like = exclude_name_patterns or (DATE_LIKE, ID_LIKE)
    reasons = {}
    rest = []
    for c in cols:
        low = c.lower()
        if any(w in low for w in date_like):
            reasons[c] = "date_like"
        elif any(w in low for w in id_like):
            reasons[c] = "id_like"
        else:
            rest.append(c)
    spark = df.sparkSession
    base = spark.createDataFrame([(i, c, reasons.get(c)) for i, c in enumerate(cols)],
                                 "ordinal int, column_name string, name_reason string")
    if rest and max_unique_ratio is not None:
        unique = near_unique(df, rest, max_unique_ratio)
        base = base.withColumn("near_unique", F.col("column_name").isin(unique) if unique else F.lit(False))
    else:
        base = base.withColumn("near_unique", F.lit(False))
    reason = F.coalesce(F.col("name_reason"),
                        F.when(F.col("near_unique"), F.lit("near_unique")), F.lit("kept"))
    return base.select("ordinal", "column_name", (reason == "kept").alias("kept"),
                       reason.alias("reason"))


def kept_columns(df: DataFrame, cols: list[str] | None = None, **kw) -> list[str]:
    """Names kept by R1, in schema order (schema-sized collect)."""
    r = corr_columns(df, cols, **kw).filter("kept").orderBy("ordinal").select("column_name")
    return [x[0] for x in r.collect()]


def pair_stats(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]] | None = None
               ) -> DataFrame:
    """``(var1, var2, n, mean1, mean2, sxx, syy, sxy)`` over pairwise-complete rows."""
    pairs = pairs or list(combinations(cols, 2))
    used = list(dict.fromkeys(c for p in pairs for c in p))
    x = clean_numeric(df, used)
    means = x.agg(*[F.avg(c).alias(c) for c in used]).first()
    shift = {c: float(means[c]) if means[c] is not None else 0.0 for c in used}

    def spread(squares, total, n):
        """Sum of squared deviations; 0 where only rounding noise of a constant is left."""
        dev = squares - F.try_divide(total * total, n)
        return F.when(dev > squares * 1e-13, dev).otherwise(F.when(n > 0, F.lit(0.0)))

    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        da = F.when(both, F.col(a) - F.lit(shift[a]))
        db = F.when(both, F.col(b) - F.lit(shift[b]))
        aggs += [F.count(da).alias(f"n{i}"), F.sum(da).alias(f"a{i}"), F.sum(db).alias(f"b{i}"),
                 F.sum(da * da).alias(f"aa{i}"), F.sum(db * db).alias(f"bb{i}"),
                 F.sum(da * db).alias(f"ab{i}")]
    wide = x.agg(*aggs)
    structs = []
    for i, (a, b) in enumerate(pairs):
        n = F.col(f"n{i}").cast("double")
        sa, sb = F.col(f"a{i}"), F.col(f"b{i}")
        structs.append(F.struct(
            F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"n{i}").cast("long").alias("n"),
            (F.lit(shift[a]) + F.try_divide(sa, n)).alias("mean1"),
            (F.lit(shift[b]) + F.try_divide(sb, n)).alias("mean2"),
            spread(F.col(f"aa{i}"), sa, n).alias("sxx"), spread(F.col(f"bb{i}"), sb, n).alias("syy"),
            (F.col(f"ab{i}") - F.try_divide(sa * sb, n)).alias("sxy")))
    return wide.select(F.inline(F.array(*structs)))


def _r(ps: DataFrame) -> DataFrame:
    den = F.sqrt(F.col("sxx") * F.col("syy"))
    r = F.when(F.col("n") > 1, F.try_divide(F.col("sxy"), den))
    # greatest and least skip nulls: an undefined r must stay null
    return ps.select("var1", "var2", "n", F.when(
        r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def corr_pearson(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """R2: ``(var1, var2, n, r)`` for every pair i < j (schema order).

    r is null where it is undefined: no common rows, or a constant column.
    """
    cols = cols or numeric_columns(df)
    return _r(pair_stats(df, cols))


def with_ranks(df: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    """Replace each column by its average rank among the column's non-null values.

    One distributed rank pass over all columns.  The ranks of columns with at most
    ``BROADCAST_CELLS`` distinct values (counted) come back by broadcast; those of all others
    come back together, in long form, by one join on (column, value) whose frequent values are
    broadcast, and one grouping by row.
    """
    x = clean_numeric(df, cols, keep=[c for c in df.columns if c not in cols])
    x = materialize(x.withColumn("_rid", F.monotonically_increasing_id()))
    cells = materialize(ranked_cells(stack_long(x, cols), ["column_name"]).select("column_name", "value", "cnt", "avg_rank"))
    sizes = {r[0]: r[1] for r in cells.groupBy("column_name").count().collect()}
    out = x
    for c in [c for c in cols if sizes.get(c, 0) <= BROADCAST_CELLS]:
        rc = F.broadcast(cells.filter(F.col("column_name") == c).select(
            F.col("value").alias("_v"), F.col("avg_rank").alias(f"_r_{c}")))
        out = out.join(rc, out[c] == rc["_v"], "left").drop(c, "_v").withColumnRenamed(f"_r_{c}", c + suffix)
    large = [c for c in cols if sizes.get(c, 0) > BROADCAST_CELLS]
    if large:
        long = stack_long(x.select("_rid", *large), large, keep=["_rid"])
        table = cells.filter(F.col("column_name").isin(large)).select(
            F.col("column_name").alias("level"), F.col("value").alias("at"), "cnt", "avg_rank")
        ranked = join_levels(long, table, {"column_name": "level", "value": "at"}, rows="cnt")
        wide = ranked.groupBy("_rid").agg(*[F.max(F.when(F.col("column_name") == c, F.col("avg_rank"))).alias(c + suffix)
                                            for c in large])
        out = out.drop(*large).join(wide, "_rid", "left")
    return out.drop("_rid")


def corr_spearman(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Spearman rho = Pearson on average ranks (ranks per column)."""
    cols = cols or numeric_columns(df)
    return _r(pair_stats(with_ranks(df.select(*cols), cols), cols))


def corr_partial(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``(var1, var2, n, r_partial)``: correlation of every pair with all other columns held fixed, over complete rows.

    One scan adds up the products of the standardised columns; the inverse of that small matrix
    gives all pairs.  Null for a constant column, where columns determine each other, or
    where there are no more rows than columns.
    """
    from statloom.operators.mixture import added_over_tasks
    from statloom.operators.prepare import complete_cases, standardize
    cols = cols or numeric_columns(df)
    p = len(cols)
    z = standardize(complete_cases(df.select(*cols), cols), cols)
    s = added_over_tasks(z, lambda x: np.concatenate([[len(x)], (x.T @ x).ravel()]))
    n = int(s[0]) if len(s) else 0
    inverse = None
    if n > p:
        r = s[1:].reshape(p, p) / n
        if np.linalg.eigvalsh(r)[0] > 1e-10:
            inverse = np.linalg.inv(r)
    rows = [(cols[i], cols[j], n, None if inverse is None else float(-inverse[i, j] / np.sqrt(inverse[i, i] * inverse[j, j])))
            for i, j in combinations(range(p), 2)]
    return df.sparkSession.createDataFrame(rows, "var1 string, var2 string, n long, r_partial double")


def _strength(r):
    a = F.abs(r)
    return (F.when(a > 0.8, F.lit("very_strong")).when(a > 0.6, F.lit("strong"))
            .otherwise(F.lit("moderate")))


def corr_significant(df: DataFrame, cols: list[str] | None = None, screen: bool = True,
                     alpha: float = SIG_ALPHA, top: int = SIG_TOP,
                     with_p: bool = True, max_unique_ratio: float | None = MAX_UNIQUE_RATIO
                     ) -> DataFrame:
    """Pairs with 0.3 < |r| < 0.99, n > 3 and p < alpha; top 20 by |r|."""
    cols = cols or numeric_columns(df)
    if screen:
        cols = kept_columns(df, cols, max_unique_ratio=max_unique_ratio)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame(
            [], "var1 string, var2 string, n long, r double, t_stat double, strength string, "
                "direction string" + (", p_value double" if with_p else ""))
    pr = corr_pearson(df, cols)
    n = F.col("n").cast("double")
    t = F.col("r") * F.sqrt(F.try_divide(n - 2, 1 - F.col("r") * F.col("r")))
    cand = (pr.filter((F.abs("r") > SIG_MIN) & (F.abs("r") < SIG_MAX) & (F.col("n") > 3))
            .withColumn("t_stat", t)
            .withColumn("p_value", t_pvalue_udf(F.col("t_stat"), n - 2))
            .filter(F.col("p_value") < alpha))
    w = Window.orderBy(F.desc(F.abs("r")), "var1", "var2")  # candidate pairs: schema-sized
    out = (cand.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= top)
           .select("var1", "var2", "n", "r", "t_stat", _strength(F.col("r")).alias("strength"),
                   F.when(F.col("r") > 0, F.lit("positive")).otherwise(F.lit("negative"))
                   .alias("direction"), "p_value", F.col("_rk").alias("rank")))
    return out if with_p else out.drop("p_value")


def corr_target(df: DataFrame, cols: list[str] | None = None, screen: bool = True,
                top: int = TARGET_TOP, max_unique_ratio: float | None = MAX_UNIQUE_RATIO
                ) -> DataFrame:
    """Per target-like column, features with |r| > 0.2, top 10 by |r|."""
    cols = cols or numeric_columns(df)
    if screen:
        cols = kept_columns(df, cols, max_unique_ratio=max_unique_ratio)
    targets = [c for c in cols if any(w in c.lower() for w in TARGET_WORDS)]
    if not targets or len(cols) < 2:
        return df.sparkSession.createDataFrame(
            [], "target string, feature string, r double, abs_r double, rank int")
    pr = corr_pearson(df, cols)
    both = pr.select(F.col("var1").alias("target"), F.col("var2").alias("feature"), "r").unionByName(
        pr.select(F.col("var2").alias("target"), F.col("var1").alias("feature"), "r"))
    both = both.filter(F.col("target").isin(targets) & (F.abs("r") > TARGET_MIN))
    w = Window.partitionBy("target").orderBy(F.desc(F.abs("r")), "feature")
    return (both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
            .select("target", "feature", "r", F.abs("r").alias("abs_r"), "rank"))


def heatmap_cells(df: DataFrame, cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """Full square Pearson matrix in long form, rounded for display."""
    cols = cols or numeric_columns(df)
    pr = corr_pearson(df, cols)
    spark = df.sparkSession
    diag = spark.createDataFrame([(c, c, 1.0) for c in cols], "var1 string, var2 string, r double")
    cells = (pr.select("var1", "var2", "r")
             .unionByName(pr.select(F.col("var2").alias("var1"), F.col("var1").alias("var2"), "r"))
             .unionByName(diag))
    return cells.select("var1", "var2", F.round("r", digits).alias("r"))


def _re_words(words):
    return "|".join(re.escape(w) for w in words)
