"""Language-model scoring over a subword lattice.

A text is a run of words and an end mark.  Every word, with the vocabulary's
word-start mark, spans a lattice of all its segmentations into pieces of an
existing vocabulary; pieces never cross a word start, so the lattice of the
text is the chain of its words' lattices.  The forward recursion, in log space,
sums all segmentations: the marginal probability of the text.

Learning: the vocabulary's own scores weight the segmentations of the training
words (where scores are merge ranks, a piece of rank r weighs 1 / (r + 1)); the
expected piece counts, over all training tokens, plus one per piece, give the
piece probabilities that score the texts.  The vocabulary itself never changes.
A character without a piece is spelled in the vocabulary's byte pieces.

Scale: distinct words are counted per task before any shuffle, and every distinct
word of all documents runs through the lattice once, into a table of words with
their count and log probability.  Documents meet that table in two ways with the same
result: at most ``HEADS`` of the most frequent words, a constant bound, go to every
task; the occurrences of all others are joined by shuffle, where no key is frequent
any more.

Cases: a null or empty text is the end mark alone; long texts are scored whole;
repeated rows are documents of their own, in counts and result; with no
training document all counts are 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

import numpy as np
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import crc_mod, doc_texts, materialize

#: Most words whose counts are sent to every task.
HEADS = 100_000
#: Distinct words a counting task holds before it passes them on, and characters whose spelling a worker remembers.
HELD = 400_000
START = "▁"
LOG10 = math.log(10)


def words_of(text: str) -> list[str]:
    """A-Z lower-cased, cut at ASCII white space."""
    return [
        w.decode("utf-8") for w in text.encode("utf-8").lower().split()]


class Lattice:
    """Pieces with log weights in a character trie, and the recursions over one word."""

    def __init__(self, weights: dict[str, float], byte_weights: list[float]):
        self.weights, self.byte_weights = weights, byte_weights
        self.chars = {w for w in weights if len(w) == 1}
        self.trie: dict = {}
        for piece, w in weights.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = w
        self.spelled: dict[str, float] = {}  # characters without a piece

    def _spell(self, c: str) -> float:
        w = self.spelled.get(c)
        if w is None:
            w = sum(self.byte_weights[b] for b in c.encode("utf-8"))
            if len(self.spelled) < HELD:
                self.spelled[c] = w
        return w

    def forward(self, word: str, arcs: list | None = None) -> list[float]:
        """Log sums over all segmentations up to every position; ``arcs`` collects (from, to, log weight)."""
        s = START + word
        n, trie, chars, log1p, exp = len(s), self.trie, self.chars, math.log1p, math.exp
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for i in range(n):
            a = alpha[i]
            if a == -math.inf:
                continue  # no piece ends here
            node, j = trie, i
            for c in s[i:]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                w = node.get("")
                if w is not None:
                    if arcs is not None:
                        arcs.append((i, j, w))
                    t, old = a + w, alpha[j]
                    alpha[j] = t if old == -math.inf else old + log1p(exp(t - old)) if t < old else t + log1p(exp(old - t))
            if s[i] not in chars:
                w = self._spell(s[i])
                if arcs is not None:
                    arcs.append((i, i + 1, w))
                t, old = a + w, alpha[i + 1]
                alpha[i + 1] = t if old == -math.inf else max(t, old) + log1p(exp(-abs(t - old)))
        return alpha

    def expected(self, word: str, times: float, total: dict) -> None:
        """Add to ``total`` how often each piece (or byte) is used, over all segmentations of ``times`` such words."""
        s = START + word
        arcs: list = []
        alpha = self.forward(word, arcs)
        n, whole, exp, chars = len(s), alpha[-1], math.exp, self.chars
        beta = [-math.inf] * (n + 1)
        beta[n] = 0.0
        for i, j, w in reversed(arcs):  # by start, last first: everything behind j is done
            b = beta[j]
            if b == -math.inf:
                continue
            t, old = w + b, beta[i]
            beta[i] = t if old == -math.inf else max(t, old) + math.log1p(exp(-abs(t - old)))
            p = times * exp(alpha[i] + t - whole)
            if j > i + 1 or s[i] in chars:
                total[s[i:j]] = total.get(s[i:j], 0.0) + p
            else:
                for key in s[i].encode("utf-8"):
                    total[key] = total.get(key, 0.0) + p


def vocabulary(path: str) -> tuple[dict[str, float], list[float]]:
    """Log weights of pieces and bytes from the scores of a sentencepiece model whose scores are merge ranks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, ranks = {}, []
    for i in range(sp.get_piece_size()):
        if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.get_score(i) <= -1e8:
            continue
        piece = sp.id_to_piece(i)
        if START not in piece[1:]:
            pieces[piece] = -math.log(1.0 - sp.get_score(i))
            ranks.append(-sp.get_score(i))
    pieces.setdefault(START, -math.log(max(ranks) + 2))  # a word may start with a character that joins no start mark
    total = math.log(sum(map(math.exp, pieces.values())) + 256 / (max(ranks) + 2))
    return {p: w - total for p, w in pieces.items()}, [-math.log(max(ranks) + 2) - total] * 256


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c, every: occurrences in the training rows, and in all rows, of ``docs`` (doc_id, text, held_out)."""
    def run(batches):
        every: Counter = Counter()
        aside: Counter = Counter()  # held out

        def out():
            other = aside.get
            return pa.RecordBatch.from_arrays(
                [pa.array(list(every), pa.string()), pa.array([n - other(w, 0) for w, n in every.items()], pa.int64()),
                 pa.array(list(every.values()), pa.int64())], names=["word", "c", "every"])

        for b in batches:
            for at in range(0, b.num_rows, 64):
                texts, held_out = (c.to_pylist() for c in b.slice(at, 64).columns)
                every.update(b"\n".join(texts).lower().split())
                aside.update(b"\n".join(itertools.compress(texts, held_out)).lower().split())
                if len(every) > HELD:
                    yield out()
                    every, aside = Counter(), Counter()
        yield out()

    return docs.select(F.col("text").cast("binary"), "held_out").mapInArrow(run, "word string, c long, every long").groupBy("word").agg(
        F.sum("c").alias("c"), F.sum("every").alias("every"))


def learn(counts: DataFrame, n_docs: int, vocabulary_: tuple[dict[str, float], list[float]]) -> tuple[dict, list, float]:
    """Log probabilities of pieces, bytes and the end mark from the expected counts of the training words (word, c)."""
    pieces, byte_weights = vocabulary_
    prior = counts.sparkSession.sparkContext.broadcast((pieces, byte_weights))

    def run(parts):
        lattice = Lattice(*prior.value)
        total: dict = {}
        for b in parts:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                lattice.expected(w, c, total)
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k if isinstance(k, str) else None for k in keys], pa.string()),
             pa.array([None if isinstance(k, str) else k for k in keys], pa.int32()),
             pa.array([total[k] for k in keys], pa.float64())], names=["piece", "byte", "n"])

    rows = counts.select("word", "c").where("c > 0").mapInArrow(run, "piece string, byte int, n double").groupBy("piece", "byte").agg(
        F.sum("n").alias("n")).collect()  # at most the vocabulary
    by_piece = {r.piece: r.n for r in rows if r.piece is not None}
    by_byte = {r.byte: r.n for r in rows if r.piece is None}
    every = sum(r.n for r in rows) + n_docs + len(pieces) + 256 + 1
    log = lambda n: math.log((n + 1) / every)
    return ({p: log(by_piece.get(p, 0.0)) for p in pieces}, [log(by_byte.get(b, 0.0)) for b in range(256)], log(n_docs))


def word_scores(counts: DataFrame, model: tuple[dict, list, float]) -> DataFrame:
    """word, c, every, lp: the log10 probability of each distinct word, over all its segmentations."""
    held = counts.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        pieces, byte_weights, _ = held.value
        lattice = Lattice(pieces, byte_weights)
        for b in parts:
            lp = [lattice.forward(w)[-1] / LOG10 for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lp, pa.float64())], names=["word", "c", "every", "lp"])

    return counts.select("word", "c", "every").mapInArrow(run, "word string, c long, every long, lp double")


def _heads(words: DataFrame, most: int) -> list:
    """The words of the largest counts, as many whole powers of two down as fit into ``most``."""
    sizes = words.groupBy(F.floor(F.log2("every")).alias("p")).count().collect()  # at most 63 rows
    floor_, total = 64, 0
    for r in sorted(sizes, key=lambda r: -r.p):
        total += r["count"]
        if total > most:
            break
        floor_ = r.p
    return words.where(F.col("every") >= (1 << floor_)).collect() if floor_ <= 62 else []


def score(docs: DataFrame, model: str, fold: int = 7, held: int = 2, heads: int = HEADS, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    ``model`` is the path of a sentencepiece model on the driver.  Rows whose
    crc32 of the id is ``held`` modulo ``fold`` are not learned from.
    """
    spark = docs.sparkSession
    texts = doc_texts(docs, id_col, text_col).withColumn("held_out", crc_mod(F.col("doc_id"), fold) == held)
    counts = materialize(word_counts(texts))
    # an end mark for every training text
    n_docs = docs.where(crc_mod(F.col(id_col).cast("long"), fold) != held).count()
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n_train = totals.n + n_docs
    per = n_train + totals.v + (n_docs > 0) + 1
    learned = learn(counts, n_docs, vocabulary(model))
    words = materialize(word_scores(counts, learned))
    top = _heads(words, heads)
    table = np.array([(math.log10((r.c + 1) / per), r.lp, r.c > 0) for r in top], np.float64).reshape(-1, 3)
    held_ = spark.sparkContext.broadcast(({r.word.encode(): i for i, r in enumerate(top)}, table))
    base_end, end = math.log10((n_docs + 1) / per), learned[2] / LOG10

    def run(batches):
        place, table = held_.value
        place, none = place.get, itertools.repeat(-1)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                cols: list[list] = [[], [], [], [], []]
                for t in part.column("text").to_pylist():
                    ws = t.lower().split()
                    found = np.fromiter(map(place, ws, none), np.int64, len(ws))
                    here = found >= 0
                    base, lp, seen = table[found[here]].sum(0).tolist()
                    cols[0].append(len(ws) + 1)
                    cols[1].append(int(seen) + (n_docs > 0))
                    cols[2].append(base + base_end)
                    cols[3].append(lp + end)
                    cols[4].append([ws[i] for i in np.flatnonzero(~here)])
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "lp", "tail"])

    rows = texts.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
                                 "lp double, tail array<string>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    tails = rows.select("row", F.explode("tail").alias("word")).join(words, "word")
    tails = tails.groupBy("row").agg(F.sum(F.log10((F.col("c") + 1) / F.lit(float(per)))).alias("more"),
                                     F.sum("lp").alias("more_lp"), F.count(F.when(F.col("c") > 0, 1)).alias("known"))
    return rows.drop("tail").join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("lp") + F.coalesce("more_lp", F.lit(0.0))).alias("score"))
