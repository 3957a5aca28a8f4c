"""Text, JSON and findings rows.

These are the tabular parts of an LLM-report pipeline re-aimed as batch jobs:
every function is a per-row expression or a grouped aggregate over the whole
``documents`` / ``conversations`` tables; no text is ever cut to a prefix
except where the cut is the feature (token budget, digest line).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
CHARS_PER_TOKEN = 4
TOKEN_BUDGET = 8000
POINT_SPLIT = r"\d+\.|•|▪|-\s"
POINT_MIN_CHARS = 20
POINT_MAX = 10
TITLE_CHARS = 50
DIGEST_LINE_CHARS = 200
DIGEST_PARTS = 5


def _strip(c):
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tokens(c) -> F.Column:
    """The fallback token estimate, characters div 4."""
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("long")


def token_estimate(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Documents, characters and estimated tokens per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_texts"),
                               F.sum(F.length(text)).cast("long").alias("chars"),
                               F.sum(tokens(F.col(text))).cast("long").alias("tokens"))


def fit_token_budget(df: DataFrame, text: str, key: str, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Keep leading lines while the running token total stays below ``budget``.

    Texts whose estimate is within the budget are returned unchanged.  The
    prefix length comes from one ``aggregate`` over the line array of each row
    (linear, no shuffle).
    """
    lines = F.split(F.col(text), "\n")
    acc0 = F.struct(F.lit(0).cast("long").alias("tot"), F.lit(0).alias("k"), F.lit(False).alias("stop"))

    def step(acc, line):
        t = F.floor(F.length(line) / CHARS_PER_TOKEN).cast("long")
        go = (~acc["stop"]) & (acc["tot"] + t < budget)
        return F.struct(F.when(go, acc["tot"] + t).otherwise(acc["tot"]).alias("tot"),
                        F.when(go, acc["k"] + 1).otherwise(acc["k"]).alias("k"),
                        (~go).alias("stop"))

    kept = F.aggregate(lines, acc0, step)
    over = tokens(F.col(text)) > budget
    fitted = F.when(over, F.array_join(F.slice(lines, 1, kept["k"]), "\n")).otherwise(F.col(text))
    return df.select(key, tokens(F.col(text)).alias("tokens_before"),
                     fitted.alias("fitted_text")).withColumn(
        "tokens_after", tokens(F.col("fitted_text")))


def json_extract(df: DataFrame, text: str, fields: dict[str, str], key: str) -> DataFrame:
    """Parse the whole string as JSON, else its outermost ``{...}``; pull fields.

    ``fields`` maps output name -> SQL type; values come from ``variant_get``.
    """
    parsed = F.coalesce(F.try_parse_json(F.col(text)),
                        F.try_parse_json(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0)))
    return df.select(key, *[F.try_variant_get(parsed, f"$.{name}", typ).alias(name)
                            for name, typ in fields.items()])


def text_points(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Split on numbering / bullets, first 10 pieces, keep those > 20 chars."""
    pieces = df.select(*keys, F.posexplode(F.split(F.col(text), POINT_SPLIT)).alias("pos", "piece"))
    p = pieces.filter(F.col("pos") < POINT_MAX).withColumn("description", _strip(F.col("piece")))
    p = p.filter(F.length("description") > POINT_MIN_CHARS)
    title = F.when(F.length("description") > TITLE_CHARS,
                   F.concat(F.substring("description", 1, TITLE_CHARS), F.lit("..."))
                   ).otherwise(F.col("description"))
    return p.select(*keys, "pos", title.alias("title"), "description")


def text_digest(df: DataFrame, text: str, group: str, order: str) -> DataFrame:
    """Per group, the first line of each of the first 5 texts (cut at 200
    characters + '...'), joined by blank lines."""
    first = F.split(F.col(text), "\n").getItem(0)
    cut = F.when(F.length(first) > DIGEST_LINE_CHARS,
                 F.concat(F.substring(first, 1, DIGEST_LINE_CHARS), F.lit("..."))).otherwise(first)
    w = Window.partitionBy(group).orderBy(order)
    top = (df.select(group, order, cut.alias("part"))
           .withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= DIGEST_PARTS))
    g = top.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_rn", "part"))).alias("_p"))
    return g.select(group, F.array_join(F.transform("_p", lambda s: s["part"]), "\n\n").alias("digest"))


def findings(sig_corr: DataFrame, outliers: DataFrame | None = None, top: int = 3) -> DataFrame:
    """Top 3 significant correlations (impact high if |r| > 0.7) and one
    outlier finding (confidence 0.8) when any column has outliers."""
    w = Window.orderBy(F.desc(F.abs("r")), "var1", "var2")  # input: at most 20 rows (R5)
    c = (sig_corr.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
         .select(F.col("rank").cast("int").alias("rank"), F.lit("correlation").alias("kind"),
                 F.concat(F.lit("Strong correlation between "), F.col("var1"), F.lit(" and "),
                          F.col("var2")).alias("title"),
                 F.format_number(F.col("r"), 2).alias("detail"),
                 F.abs("r").alias("confidence"),
                 F.when(F.abs("r") > 0.7, "high").otherwise("medium").alias("impact")))
    if outliers is None:
        return c
    o = (outliers.agg(F.sum("count").alias("_n")).filter(F.col("_n") > 0)
         .select(F.lit(top + 1).alias("rank"), F.lit("outliers").alias("kind"),
                 F.lit("Outliers detected in the dataset").alias("title"),
                 F.concat(F.col("_n").cast("string"), F.lit(" outlying values")).alias("detail"),
                 F.lit(0.8).alias("confidence"), F.lit("medium").alias("impact")))
    return c.unionByName(o)


def report_rows(results: dict[str, DataFrame]) -> DataFrame:
    """``(section, rank, title, value)`` rows summarising an analysis run."""
    spark = next(iter(results.values())).sparkSession
    rows = [spark.createDataFrame([(i + 1, k) for i, k in enumerate(sorted(results))],
                                  "rank int, title string")
            .select(F.lit("analyses").alias("section"), "rank", "title", F.lit(None).cast("string").alias("value"))]
    if "significant_correlations" in results:
        rows.append(results["significant_correlations"].agg(F.count(F.lit(1)).alias("v")).select(
            F.lit("correlations").alias("section"), F.lit(1).alias("rank"),
            F.lit("significant correlations").alias("title"), F.col("v").cast("string").alias("value")))
    if "pca_variance" in results:
        rows.append(results["pca_variance"].filter(F.col("cumulative") >= 0.95).agg(
            F.min("component").alias("v")).select(
            F.lit("pca").alias("section"), F.lit(1).alias("rank"),
            F.lit("components for 95% variance").alias("title"), F.col("v").cast("string").alias("value")))
    if "findings" in results:
        rows.append(results["findings"].filter(F.col("rank") <= 5).select(
            F.lit("findings").alias("section"), F.col("rank").cast("int").alias("rank"),
            "title", "detail"  # noqa
        ).withColumnRenamed("detail", "value"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
