"""Periodic runs of words, found by multi-scale minimizers and direct lag scans.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical), at least ``max(MIN_LENGTH, MIN_REPEATS * q)`` words long, that
no neighbouring word extends.

Periods up to ``SHORT`` words are found by comparing the words with themselves
at every such lag.  Longer periods are found by scale: at scale k (8, 16, 32,
...) the windows of k neighbouring k-word hashes each mark their minima (ties
all count).  Inside a run whose period lies in [2k, 4k) the marks repeat at
period distance, so two equal marks at that distance seed an extension, word by
word, to both sides.  Of marks of one hash that follow each other within k/2
words only the first is paired: such a chain is itself a stretch of a shorter
period, and a run with four periods always holds an unchained mark together
with its copy one period on.  So a mark has at most eight partners.  Seeds are
checked on the words themselves; a 64-bit hash only proposes them.

Every document is one row of work inside one task and nothing is shuffled;
the documents of an Arrow batch are scanned together, cut by words that occur
once.

Cases: a null or empty text has no words, no runs and collapses to the empty
string; whole texts are read, of any length; repeated rows give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import doc_texts

MIN_LENGTH = 6
MIN_REPEATS = 4
#: Longest period that lag scans look for; the first scale starts above it.
SHORT = 15
FIRST_SCALE = 8
#: Bytes of text whose words are scanned together.
TOGETHER = 4 << 20

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                       T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])


class _Numbers(dict):
    """Word -> its number, given at first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _over_windows(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every window of ``width`` entries, from running bests of blocks."""
    n = len(x)
    fill = x.dtype.type(np.iinfo(x.dtype).max if best is np.minimum else 0)
    blocks = np.concatenate([x, np.full(-n % width, fill)]).reshape(-1, width)
    ahead = best.accumulate(blocks, axis=1).ravel()
    back = best.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n - width + 1], ahead[width - 1:n])


def _marks(h: np.ndarray, width: int) -> np.ndarray:
    """Positions that are a minimum of some window of ``width`` hashes."""
    low = _over_windows(h, width, np.minimum)
    edge = np.zeros(width - 1, h.dtype)  # windows beyond the ends do not count
    return np.flatnonzero(_over_windows(np.concatenate([edge, low, edge]), width, np.maximum) == h)


def _seeds(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of equal unchained marks that lie 2k to 4k - 1 words apart."""
    at = _marks(h, k)
    at = at[np.argsort(h[at], kind="stable")]
    key = h[at]
    chained = np.zeros(len(at), bool)
    chained[1:] = (key[1:] == key[:-1]) & (at[1:] - at[:-1] <= k // 2)
    at, key = at[~chained], key[~chained]
    found = [(at[:0], at[:0])]
    for j in range(1, len(at)):
        gap = at[j:] - at[:-j]
        near = (key[j:] == key[:-j]) & (gap < 4 * k)
        if not near.any():
            break
        near &= gap >= 2 * k
        found.append((at[:-j][near], gap[near]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _agree(w: np.ndarray, a: int, b: int) -> int:
    """How many words from ``a`` and from ``b`` (a < b) on are equal."""
    n, step, got = len(w), 64, 0
    while b + got < n:
        c = min(step, n - b - got)
        differ = w[a + got:a + got + c] != w[b + got:b + got + c]
        if differ.any():
            return got + int(differ.argmax())
        got += c
        step *= 2
    return got


def _is_run(w: np.ndarray, start: int, length: int, q: int) -> bool:
    """Long enough, and of no shorter period (which would divide q, as there are four repeats)."""
    if length < max(MIN_LENGTH, MIN_REPEATS * q):
        return False
    block = w[start:start + q]
    rest, prime = q, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            p = q // prime
            if np.array_equal(block[p:], block[:-p]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _short(w: np.ndarray, q: int):
    """Runs of period ``q`` by one comparison of the words with those q on."""
    hit = np.flatnonzero(w[q:] == w[:-q])
    if not len(hit):
        return
    cut = np.flatnonzero(np.diff(hit) != 1) + 1
    first, last = hit[np.r_[0, cut]], hit[np.r_[cut - 1, len(hit) - 1]]
    for i in np.flatnonzero(last - first + 1 + q >= max(MIN_LENGTH, MIN_REPEATS * q)):
        start, length = int(first[i]), int(last[i] - first[i]) + 1 + q
        if _is_run(w, start, length, q):
            yield start, length, q


def find_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each sequence of word numbers, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) for i in order], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    w = np.empty(int(starts[-1]), np.int64)
    for nth, i in enumerate(order):
        w[starts[nth]:starts[nth + 1] - 1] = texts[i]
        w[starts[nth + 1] - 1] = -1 - nth  # a word of its own behind every text
    flipped = w[::-1]

    def upto(least: int) -> int:
        """Words of the texts with at least so many words, which come first."""
        return int(starts[np.searchsorted(-sizes, -least, side="right")])

    got = []
    for q in range(1, SHORT + 1):
        n = upto(max(MIN_LENGTH, MIN_REPEATS * q))
        if n > q:
            got += _short(w[:n], q)
    k, n = 1, len(w)
    h = _mixed(w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    while (n := upto(2 * MIN_REPEATS * k)) > 4 * k:
        h = h[:n - k + 1]
        if k >= FIRST_SCALE:
            at, gaps = _seeds(h, k)
            done_q, done_to = 0, 0
            for i in np.lexsort((at, gaps)):
                m, q = int(at[i]), int(gaps[i])
                if q == done_q and m < done_to:
                    continue
                right = _agree(w[:n], m, m + q)
                left = _agree(flipped, len(w) - m - q, len(w) - m)
                done_q, done_to = q, m + right + 1
                if _is_run(w, m - left, left + right + q, q):
                    got.append((m - left, left + right + q, q))
        if n <= 2 * k:
            break
        h = _mixed(h[:-k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
        k *= 2
    out: list[list] = [[] for _ in texts]
    for start, length, q in sorted(got):
        nth = int(np.searchsorted(starts, start, side="right")) - 1
        out[order[nth]].append((start - int(starts[nth]), length, q))
    return out


def _collapse(words: list[bytes], runs) -> bytes:
    """The words without those that any run holds behind its first period."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period) and the collapsed text of every row."""

    def scan(texts: list[bytes]):
        numbers = _Numbers()
        words = [t.split() for t in texts]  # of bytes, splits at the six ASCII white-space characters alone
        runs = find_runs([np.fromiter(map(numbers.__getitem__, x), np.int64, len(x)) for x in words])
        return [(len(x), [dict(zip(("start", "length", "period"), r)) for r in rs], _collapse(x, rs).decode())
                for x, rs in zip(words, runs)]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at + 1, len(texts[at])
                while to < len(texts) and size + len(texts[to]) <= TOGETHER:
                    size += len(texts[to])
                    to += 1
                n, runs, collapsed = zip(*scan(texts[at:to]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(n, pa.int64()),
                     pa.array(runs, pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))),
                     pa.array(collapsed, pa.string())], names=SCHEMA.names)
                at = to

    return doc_texts(docs, id_col, text_col).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text where the texts whose id has a crc32 divisible by 10 end in copies of a stretch of their words.

    With g = crc32 // 10 and n words, word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    Rows without an id or without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = doc_texts(docs, id_col, text_col).withColumn("_w", F.when(h % 10 == 0, words))
    g, n = F.floor(h / 10), F.size("_w")
    rows = rows.withColumn("_a", F.when(n > 0, g % n).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + g % 8))).cast("int"))
    copied = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(
        F.get(F.col("_w"), F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), F.concat_ws(" ", copied)).otherwise(
        F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The greatest run and the SHA-256 of all runs and of the collapsed text."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = found.withColumn("_b", top)
    length, period = F.col("_b.length"), -F.col("_b.p")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.s")).alias("start"),
                       length.alias("length"), period.alias("period"),
                       F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                       F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
