"""URL filter: host rules first, else logistic regression on hashed character n-grams of host and path.

Everything is DataFrame functions.  The small labelled table becomes one row;
its Gram matrix and the gradient steps on the dual coefficients are array
expressions (from zero, they give the weights of plain gradient descent with an
L2 penalty).  The weights per hash bucket (``BUCKETS`` numbers, whatever the
input) are then a constant of the scoring expression, so judging is one scan of
the urls without a shuffle.

Cases: a null url, or one without ``://``, has empty host and path, fits no
rule, and is judged by the method on its empty features (the bias alone); long
urls are judged whole; repeated rows are judged alike; an empty table gives no
rows; an empty labelled table gives weights of zero and so ``allow``; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 8_192
GRAMS = (3, 4)
STEPS = 300
RATE = 1.0
PENALTY = 0.002
BLOCK_AT = 0.7

#: Names of the labelled hosts; the table puts each under the same prefixes, domains and paths.
UNWANTED = (
    "casino-royal", "online-casino", "casino-win", "grand-casino", "poker-win", "win-jackpot", "win-big", "free-spins",
    "best-bets", "sports-bets", "free-bets", "bets-online", "free-money", "cheap-meds", "pills-shop", "cheap-pills",
    "online-pills", "cheap-watches", "cheap-loans", "payday-loans", "spam-links", "link-farm", "seo-spam", "spam-mail",
    "content-farm", "spam-farm", "ads-server", "click-track", "ad-track", "ads-track", "track-ads", "ads-network",
    "adult-chat", "adult-video", "adult-x", "xxx-adult", "porn-tube", "sex-cams", "malware-drop", "phish-login")
WANTED = (
    "library", "university", "newspaper", "garden", "documents", "museum", "weather", "recipes", "history", "travel",
    "science", "cooking", "theatre", "mountain", "composers", "threads", "articles", "council", "lessons", "hospital",
    "another", "station", "northern", "thereon", "earth", "nation", "inherit", "together", "ethernet", "other-things",
    "weekend", "street-map", "open-data", "city-guide", "reading", "thousand", "stable", "southern", "then", "thin")
PREFIXES = ("", "www.", "blog.", "m.")
DOMAINS = ("example.com", "example.net", "example.org")
PATHS = ("/en/12", "/de/345.html", "/fr/6/", "/es/78?page=2", "/en/901#top")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    cut = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(text, cut, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(text, cut, 2)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule (``host/path``) that fits, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: (len(x), x)):  # the longest is put on last, outermost
        name, slash, rest = r.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(r)).otherwise(rule)
        verdict = F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column, buckets: int = BUCKETS) -> Column:
    """Distinct hash buckets of the n-grams of ``^host$`` and ``/path$``."""
    def grams(part: str, text: Column, n: int) -> Column:
        last = F.length(text) - (n - 1)
        at = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(f"{part}{n}"), F.substring(text, i, n)),
                                                F.lit(buckets)).cast("int"))

    empty = (host == "") & (path == "")
    host, path = F.concat(F.lit("^"), host, F.lit("$")), F.concat(path, F.lit("$"))
    every = [grams(part, text, n) for part, text in (("h", host), ("p", path)) for n in GRAMS]
    return F.when(empty, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(*every)))


def labelled(spark: SparkSession) -> DataFrame:
    """url, label of the small labelled table: both classes meet every prefix, domain and path."""
    rows = []
    for label, names in ((1, UNWANTED), (0, WANTED)):
        for i, name in enumerate(names):
            prefix, domain, path = PREFIXES[i % 4], DOMAINS[i % 3], PATHS[i % 5]
            rows.append((f"http://{prefix}{name}.{domain}{path}", label))
    return spark.createDataFrame(rows, "url string, label int")


def train(table: DataFrame, buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE,
          penalty: float = PENALTY) -> tuple[list[float], float]:
    """Weight of every bucket, and the bias.  ``table`` (url, label) must be small: it becomes one row."""
    host, path = host_and_path(F.col("url"))
    rows = table.select("url", F.col("label").cast("double").alias("y"), features(host, path, buckets).alias("f"))
    one = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("url", "y", "f"))).alias("rows"))
    near = F.transform("rows", lambda a: F.transform("rows", lambda b: 1.0 + F.size(F.array_intersect(a["f"], b["f"]))
                       / F.sqrt(F.greatest(F.size(a["f"]) * F.size(b["f"]), F.lit(1)).cast("double"))))
    one = one.withColumn("gram", near).withColumn("y", F.transform("rows", lambda a: a["y"]))

    def dot(u, v):
        return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(alpha, _):
        p = F.transform("gram", lambda row: 1.0 / (1.0 + F.exp(-dot(row, alpha))))
        miss = F.zip_with("y", p, lambda y, q: (y - q) * rate / F.greatest(F.size("rows"), F.lit(1)) * 10)
        return F.zip_with(alpha, miss, lambda a, d: a * (1 - penalty * rate) + d)

    zero = F.transform("y", lambda _: F.lit(0.0))
    one = one.withColumn("alpha", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step))
    each = one.select(F.explode(F.arrays_zip("rows", "alpha")).alias("x")).select(
        F.col("x.rows.f").alias("f"), F.col("x.alpha").alias("a"))
    # bucket -1 holds the bias
    parts = each.select(F.explode(F.concat(F.array(F.lit(-1)), "f")).alias("b"), "a", F.size("f").alias("n"))
    value = F.when(F.col("b") < 0, F.col("a")).otherwise(F.col("a") / F.sqrt(F.col("n").cast("double")))
    weights = [0.0] * buckets
    bias = 0.0
    for r in parts.groupBy("b").agg(F.sum(value).alias("w")).collect():  # at most `buckets` + 1 rows
        if r.b < 0:
            bias = r.w
        else:
            weights[r.b] = r.w
    return weights, bias


def judge(pages: DataFrame, rules: dict[str, str], model: tuple[list[float], float], block_at: float = BLOCK_AT,
          id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's, whether or not a rule decided)."""
    weights, bias = model
    known = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    host, path = host_and_path(F.col(url_col))
    df = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    f = features(F.col("host"), F.col("path"), len(weights))
    df = df.withColumn("f", f)
    total = F.aggregate("f", F.lit(0.0), lambda s, b: s + F.element_at(known, b + 1))
    z = total / F.sqrt(F.greatest(F.size("f"), F.lit(1)).cast("double")) + F.lit(float(bias))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = 1.0 / (1.0 + F.exp(-z))
    df = df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    return df.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(
        F.col("score") >= block_at, "block").otherwise("allow")).alias("verdict"), "score")
