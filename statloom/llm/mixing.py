"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order fixed by the MD5 of its id, has
the virtual finish time (source tokens up to and including it) / (the source's
target).  A source whose target exceeds its size is read again, pass after
pass.  The mix is the global order by virtual finish time, cut where the total
budget (all tokens of the table) is reached.

Targets: sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3, ... and
share the budget by weight; no target exceeds ``MAX_PASSES`` times its source's
size, what is above goes to the others by weight until none is above.

Running sums go through buckets: sums per bucket, a running sum over the
buckets, then a window inside each bucket.  So a source with a third of all
rows is spread over many tasks, and neither order passes one task.

Cases: null texts and texts without words have size 0 and are never taken;
repeated rows are documents of their own, and those that the order cannot tell
apart are taken together or not at all only by size; an empty table gives an
empty mix; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statloom.llm.common import materialize

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Rows that a bucket of a running sum holds about.
BUCKET_ROWS = 5_000
#: Fixed value: what splits words.
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size, target: one row per source, by water level instead of repeated rounds.

    With sources sorted by cap / weight, the capped ones are a prefix; the level
    of the others is (budget - caps of the prefix) / (weights behind the prefix).
    The table has one row per source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("source_size") * F.lit(1.0) / F.col("weight"), F.col("source").asc_nulls_last())
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = len(weights)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % n + 1).cast("int")).cast("long"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    t = t.withColumns({"budget": F.sum("source_size").over(whole),
                       "caps": F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_passes,
                       "open": F.sum("weight").over(rest)})
    t = t.withColumn("level", (F.col("budget") - F.col("caps")).cast("double") / F.col("open"))
    # the first source that its level leaves at or under its cap sets the level of all behind it
    fits = F.col("level") * F.col("weight") <= F.col("source_size") * max_passes
    t = t.withColumn("level", F.coalesce(F.min(F.when(fits, F.struct("caps", "level"))).over(whole)["level"], F.lit(0.0)))
    return t.select("source", "source_size", F.least(
        F.col("level") * F.col("weight"), (F.col("source_size") * max_passes).cast("double")).alias("target"))


def _buckets(rows: int) -> int:
    return 1 << max(6, math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))


def _running(df: DataFrame, groups: list[str], bucket: str, order: list, value: str, out: str,
             limit: int | None = None) -> DataFrame:
    """``out``: running sum of ``value`` per group in ``order``, which must follow ``bucket``.

    ``limit``: buckets that start above it are left out whole.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("_s"))
    upto = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    sums = sums.withColumn("_before", F.sum("_s").over(upto.orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("_s")).drop("_s")
    if limit is not None:  # rows behind the limit leave before the shuffle
        last = sums.where(F.col("_before") <= F.lit(limit)).agg(F.max(bucket)).first()[0]
        df = df.where(F.col(bucket) <= F.lit(-1 if last is None else last))
    keys = [*groups, bucket]
    inside = F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(sums, keys).withColumn(out, inside + F.col("_before")).drop("_before")


def _source_key() -> Column:
    """The source as a join key that also holds null."""
    return F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))


#: DuckDB's version of op6 over the view ``documents``.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM src),
lv AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                 / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level,
              row_number() OVER (o) AS nth
       FROM w WINDOW o AS (ORDER BY source_size * 1.0::DOUBLE / weight, source NULLS LAST)),
lvl AS (SELECT coalesce(arg_min(level, nth), 0.0) AS level FROM lv WHERE level * weight <= 3 * source_size),
t AS (SELECT w.source, source_size, least(lvl.level * weight, (3 * source_size)::DOUBLE) AS target FROM w, lvl),
d AS (SELECT s.*, t.source_size, t.target,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY h, doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT AS cum
      FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
served AS (SELECT d.*, p.pass, (cum + p.pass * source_size)::DOUBLE / target AS vft
           FROM d, (SELECT unnest([0, 1, 2]) AS pass) p
           WHERE size > 0 AND p.pass <= ceil(target / source_size)),
total AS (SELECT *, sum(size) OVER (ORDER BY vft, source NULLS LAST, pass, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS total
          FROM served),
kept AS (SELECT doc_id, source, size, cum, count(*) AS copies FROM total
         WHERE total <= (SELECT sum(source_size) FROM src) GROUP BY ALL)
SELECT d.doc_id, d.size, d.source_size, d.target, (d.size * coalesce(k.copies, 0))::BIGINT AS taken
FROM d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id AND d.source IS NOT DISTINCT FROM k.source
  AND d.size = k.size AND d.cum = k.cum
"""


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       word_count(F.col(text_col)).alias("size"))


def mix(sized: DataFrame, weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, copies of every row of doc_id, source, size."""
    sized = materialize(sized)
    n_rows = sized.count()
    targets = materialize(source_targets(sized, weights, max_passes))
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    b1 = _buckets(n_rows)
    ranked = targets.withColumn("s", _source_key())
    docs = sized.withColumn("s", _source_key())
    docs = docs.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    docs = docs.withColumn("b", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(2 ** 32 / b1)))
    docs = _running(docs, ["s"], "b", [F.col("h"), F.col("doc_id"), F.col("size")], "size", "cum")
    # one row per source; large source tables are joined by shuffle, small ones by broadcast, as their size shows
    docs = docs.join(ranked.select("s", "source_size", "target"), "s")
    docs = materialize(docs.select("doc_id", "source", "size", "h", "cum", "source_size", "target"))
    # passes that can still finish within the budget; sources at their cap have exactly max_passes
    passes = F.least(F.lit(max_passes), F.ceil(F.col("target") / F.col("source_size")) + 1).cast("int")
    served = docs.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    served = served.withColumn("vft", (F.col("cum") + F.col("pass") * F.col("source_size")).cast("double") / F.col("target"))
    b2 = _buckets(n_rows)
    served = served.withColumn("b", F.least(F.floor(F.col("vft") * b2), F.lit(2 * b2)).cast("long"))
    served = _running(served, [], "b", [F.col("vft"), F.col("source").asc_nulls_last(), F.col("pass"), F.col("h"),
                                        F.col("doc_id"), F.col("size")], "size", "total", budget)
    kept = served.where(F.col("total") <= F.lit(budget)).groupBy("doc_id", "source", "size", "cum").agg(
        F.count("*").alias("copies"))
    on = [F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")), F.col("d.source").eqNullSafe(F.col("k.source")),
          F.col("d.size") == F.col("k.size"), F.col("d.cum") == F.col("k.cum")]
    out = docs.alias("d").join(kept.alias("k"), on, "left")
    copies = F.coalesce(F.col("k.copies"), F.lit(0))
    return out.select("d.doc_id", "d.size", "d.source", "d.source_size", "d.target",
                      (F.col("d.size") * copies).alias("taken"), copies.alias("copies"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights=WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as the mix reads it."""
    def key(doc_id, source, size):
        return F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("-")), size.cast("string"),
                           F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)))

    mixed = mix(sizes(docs, id_col, text_col, source_col), weights, max_passes)
    taken = mixed.groupBy(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("_key")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_alike")).where("_copies > 0")
    rows = docs.withColumn("_key", key(F.col(id_col).cast("long"), F.col(source_col).cast("string"), word_count(F.col(text_col))))
    # rows alike in id, source and size share their copies out evenly
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(text_col))))
    rows = rows.join(taken, "_key")
    copies = F.floor(F.col("_copies") / F.col("_alike")) + (F.col("_nth") <= F.col("_copies") % F.col("_alike")).cast("int")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(max_passes)))).where(
        F.col("_copy") <= copies).select(*docs.columns)
