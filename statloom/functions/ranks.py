"""Global ranks (primitive GR) and exact quantiles without a one-task window.

``Window.orderBy(x)`` with no partition sends every row to one task.  Here
ranks are computed on *value cells* ``(group..., value, cnt)`` (a map-side
combined count, so repeated values cost one row) and, when the cell table is
larger than ``WINDOW_CELL_BOUND``, by range partitioning the cells, summing
each range partition (a table of about ``P`` rows), and adding those offsets
to a per-partition running sum.  Range bounds are sampled anew by every
exchange, so the ranged cells are written once, with their partition number,
through the reliable checkpoint; offsets and running sums both read that copy.

Equal values always share one cell, so average ranks for ties come out of
``cum_before + (cnt + 1) / 2`` with no extra pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statloom.functions.exprs import clean_numeric, stack_long
from statloom.session import ensure_checkpoint_dir, ensure_parallelism

# Cells per window task we accept before switching to range partitioning.
WINDOW_CELL_BOUND = 2_000_000
CELLS_PER_RANGE_PARTITION = 1_000_000


def value_cells(long_df: DataFrame, group: list[str], value: str = "value",
                weight: str | None = None) -> DataFrame:
    """``(group..., value, cnt)``: one row per distinct value per group."""
    agg = F.sum(weight).cast("long") if weight else F.count(F.lit(1))
    return long_df.groupBy(*group, value).agg(agg.alias("cnt"))


def cumulate(cells: DataFrame, group: list[str], value: str = "value",
             cnt: str = "cnt", window_bound: int | None = None,
             max_group_cells: float | None = None) -> DataFrame:
    """Add ``cum_before`` (rows with a smaller value in the group) and ``n``.

    Input must have one row per (group, value).  Output keeps all columns.
    A window per group is used when the largest group holds at most
    ``window_bound`` cells (one task sorts one group).  ``max_group_cells`` is
    a proven upper bound supplied by the caller (e.g. the largest non-null
    count); without it the cells are checkpointed and the group sizes counted.
    """
    spark = cells.sparkSession
    window_bound = WINDOW_CELL_BOUND if window_bound is None else window_bound
    if max_group_cells is not None and max_group_cells <= window_bound:
        biggest = max_group_cells
    else:
        ensure_checkpoint_dir(spark)
        cells = cells.checkpoint(eager=True)
        biggest = cells.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    if biggest <= window_bound:
        w = Window.partitionBy(*group).orderBy(value)
        wg = Window.partitionBy(*group)
        return (cells
                .withColumn("cum_before", F.coalesce(
                    F.sum(cnt).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0)).cast("long"))
                .withColumn("n", F.sum(cnt).over(wg).cast("long")))
    total = cells.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-total // CELLS_PER_RANGE_PARTITION))
    # offsets and local sums must see the same ranges: the ranged rows are
    # written once, with their partition number, and both frames read that
    ranged = (cells.repartitionByRange(parts, *group, value)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    part_tot = ranged.groupBy("_pid", *group).agg(F.sum(cnt).alias("_psum"))
    wo = Window.partitionBy(*group).orderBy("_pid")
    offsets = (part_tot
               .withColumn("_off", F.coalesce(F.sum("_psum").over(
                   wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("n", F.sum("_psum").over(Window.partitionBy(*group)))
               .drop("_psum"))
    wl = Window.partitionBy("_pid", *group).orderBy(value)
    local = ranged.withColumn("_local", F.coalesce(F.sum(cnt).over(
        wl.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (local.join(offsets, ["_pid", *group])
            .withColumn("cum_before", (F.col("_off") + F.col("_local")).cast("long"))
            .withColumn("n", F.col("n").cast("long"))
            .drop("_pid", "_off", "_local"))


def ranked_cells(long_df: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """Cells with average rank (1-based) for each distinct value."""
    c = cumulate(value_cells(long_df, group, value), group, value)
    return c.withColumn("avg_rank", F.col("cum_before") + (F.col("cnt") + 1) / 2.0)


def quantiles_from_cells(cum: DataFrame, group: list[str], probs: list[float],
                         value: str = "value") -> DataFrame:
    """Linear-interpolated quantiles ``(group..., prob, q)`` from cumulated cells.

    Only the cells that hold a probed rank survive the filter (at most two per
    probability and group), so the interpolation step is tiny.
    """
    lo_hit, hi_hit, any_hit = [], [], []
    start, end = F.col("cum_before"), F.col("cum_before") + F.col("cnt")
    for p in probs:
        h = (F.col("n") - 1).cast("double") * p
        lo, hi = F.floor(h), F.ceil(h)
        lo_hit.append((start <= lo) & (lo < end))
        hi_hit.append((start <= hi) & (hi < end))
        any_hit.append(lo_hit[-1] | hi_hit[-1])
    cond = any_hit[0]
    for c in any_hit[1:]:
        cond = cond | c
    hits = cum.filter(cond).select(
        *group, value, "n",
        F.inline(F.array(*[F.struct(F.lit(float(p)).alias("prob"),
                                     lo_hit[i].alias("is_lo"), hi_hit[i].alias("is_hi"))
                           for i, p in enumerate(probs)])))
    hits = hits.filter(F.col("is_lo") | F.col("is_hi"))
    agg = hits.groupBy(*group, "prob").agg(
        F.max(F.when(F.col("is_lo"), F.col(value))).alias("_lo"),
        F.max(F.when(F.col("is_hi"), F.col(value))).alias("_hi"),
        F.max("n").alias("_n"))
    h = (F.col("_n") - 1).cast("double") * F.col("prob")
    frac = h - F.floor(h)
    return agg.select(*group, "prob",
                      (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias("q"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float],
                    by: list[str] | None = None, max_group_cells: float | None = None) -> DataFrame:
    """Exact linear quantiles of numeric ``cols``: ``(column_name, by..., prob, q)``.

    Strategy by a proven size bound: when the largest column holds at most
    ``WINDOW_CELL_BOUND`` values (an exact count, or the caller's bound), its
    value cells are ranked by one window task per column.  Larger columns go
    to distributed selection (``functions.select``): a few small aggregates
    over column scans and no shuffle of the values.  With ``by`` (an unbounded
    number of groups) the ranked-cell path with its range-partitioned variant
    is used.
    """
    if not by:
        if max_group_cells is None:
            x = clean_numeric(df, cols)
            r = x.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
            max_group_cells = max([r[f"n{i}"] or 0 for i in range(len(cols))] or [0])
        if max_group_cells > WINDOW_CELL_BOUND:
            from statloom.functions.select import exact_quantiles_select
            return exact_quantiles_select(df, cols, probs)
    by = by or []
    long = stack_long(clean_numeric(ensure_parallelism(df), cols, keep=by), cols, keep=by)
    group = ["column_name", *by]
    cum = cumulate(value_cells(long, group), group, max_group_cells=max_group_cells)
    return quantiles_from_cells(cum, group, probs)


def quantile_wide(df: DataFrame, cols: list[str], probs: list[float],
                  names: list[str], by: list[str] | None = None,
                  max_group_cells: float | None = None) -> DataFrame:
    """One row per column (and by-group) with one quantile per output name."""
    by = by or []
    q = exact_quantiles(df, cols, probs, by, max_group_cells)
    return q.groupBy("column_name", *by).agg(*[
        F.max(F.when(F.col("prob") == float(p), F.col("q"))).alias(nm)
        for p, nm in zip(probs, names)])


def global_row_number(df: DataFrame, order: list[str]) -> DataFrame:
    """1-based row number over a total order given by ``order`` (unique key last).

    Distributed: cells are single rows here, so the range path of
    :func:`cumulate` is used whenever the table is large.
    """
    keyed = df.withColumn("_ord", F.struct(*order)).withColumn("_g", F.lit(0))
    cells = keyed.withColumn("cnt", F.lit(1).cast("long"))
    cum = cumulate(cells, ["_g"], "_ord")
    return cum.withColumn("row_number", F.col("cum_before") + 1).drop(
        "_ord", "_g", "cnt", "cum_before", "n")
