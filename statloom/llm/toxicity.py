"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, in numpy.

A word's input is its own embedding (words met in several training documents)
beside the scaled sum of the embeddings of its character n-grams, so unseen
inflections and spellings still carry signal.  The network reads windows of
``WINDOW`` words that start every ``STRIDE`` words over the whole text (so a
passage of up to ``WINDOW - STRIDE + 1`` words lies whole in one), pools the
states of both directions by attention, and gives each window a probability; a
text's score is that of its worst window.

Training: on the driver, from a bounded sample of labelled training rows (at
most ``MAX_TOXIC`` and ``MAX_CLEAN`` by hash of the id, at most ``MAX_WINDOWS`` windows of each, drawn evenly
over longer texts), so its size is bounded whatever the texts' length.  A label holds for a text, not for its windows, so every epoch after the first picks from each toxic text the windows that
score highest now, and from each clean text its highest and some others.

Cases: a null or blank text is one window without words and scores by the bias;
very long texts are scored whole; repeated rows score alike; a doc_id labelled
more than once counts as toxic if any label says so; null labels are left out;
without labelled rows of both kinds every text scores 0; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import crc_mod, doc_texts

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 16
GRAMS = (5,)
#: A word or n-gram needs as many training documents to get an embedding.
LEAST_DOCS = 3
MAX_TOXIC, MAX_CLEAN = 800, 3_000
#: Training windows of one text (scoring reads all windows of all texts).
MAX_WINDOWS = 512
EPOCHS, BATCH, RATE = 10, 128, 0.01
TOXIC_AT = 0.7
#: Projected words a Python worker holds.
MEMO = 250_000
SEED = 3
#: ASCII other than letters and digits splits words; what is not ASCII is part of them.
SPLIT = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words, as UTF-8."""
    return text.lower().encode("utf-8").translate(SPLIT).split()


def grams_of(word: bytes) -> list[bytes]:
    w = b"^" + word + b"$"
    return [w[i:i + n] for n in GRAMS for i in range(max(1, len(w) - n + 1))]


def window_starts(n: int) -> range:
    """Starts of the overlapping windows that cover ``n`` words; one window at least."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Net:
    """Parameters and passes.  Inputs are projected per word, so a step costs only the recurrent part."""

    def __init__(self, words: list[bytes], grams: list[bytes], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.word_at = {w: i + 1 for i, w in enumerate(words)}  # row 0: unseen, stays zero
        self.gram_at = {g: i + 1 for i, g in enumerate(grams)}
        h, d = HIDDEN, WORD_DIM + CHAR_DIM
        self.p = {"word": rng.normal(0, 0.1, (len(words) + 1, WORD_DIM)), "gram": rng.normal(0, 0.1, (len(grams) + 1, CHAR_DIM)),
                  "pool": rng.normal(0, 0.1, 2 * h), "out": rng.normal(0, 0.3, 2 * h), "bias": np.array([-1.0])}
        for s in "fb":
            self.p |= {f"w{s}": rng.normal(0, 1 / np.sqrt(d), (d, 3 * h)), f"u{s}": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
                       f"c{s}": np.zeros(3 * h)}
        self.p["word"][0] = self.p["gram"][0] = 0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def parts(self, word: bytes) -> tuple[int, list[int]]:
        at = self.gram_at.get
        return self.word_at.get(word, 0), [i for i in map(at, grams_of(word)) if i]

    def inputs(self, parts) -> tuple[np.ndarray, tuple]:
        """Input rows of words given as (word row, gram rows), and what the backward pass needs."""
        rows = np.array([w for w, _ in parts], np.int64)
        sizes = np.array([len(g) for _, g in parts], np.int64)
        flat = np.array([i for _, g in parts for i in g], np.int64)
        owner = np.repeat(np.arange(len(parts)), sizes)
        scale = (1 / np.sqrt(np.maximum(sizes, 1))).astype(np.float32)
        chars = np.zeros((len(parts), CHAR_DIM), np.float32)
        some = np.flatnonzero(sizes)
        if len(some):
            chars[some] = np.add.reduceat(self.p["gram"][flat], np.cumsum(sizes)[some] - sizes[some])
        return np.concatenate([self.p["word"][rows], chars * scale[:, None]], 1), (rows, flat, owner, scale)

    def project(self, x):
        return np.concatenate([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]], 1)

    def forward(self, proj, at, keep=False):
        """Logit of every window; ``at``: words of each window as rows of ``proj``, -1 behind the end.

        ``proj``: projected words, or the halves of both directions as arrays of their own.
        """
        p, h3, n, t = self.p, 3 * HIDDEN, len(at), at.shape[1]
        there = (at >= 0).astype(np.float32)
        states, trace = [], {}
        halves = proj if isinstance(proj, tuple) else tuple(map(np.ascontiguousarray, (proj[:, :h3], proj[:, h3:])))
        for s, half, order in (("f", halves[0], range(t)), ("b", halves[1], range(t - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            out = np.empty((t, n, HIDDEN), np.float32)
            steps = []
            for i in order:
                m = there[:, i:i + 1]
                g, r = half[at[:, i]], h @ p[f"u{s}"]
                zr = sigmoid(g[:, :2 * HIDDEN] + r[:, :2 * HIDDEN])
                z, reset = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN:] + reset * r[:, 2 * HIDDEN:])
                nxt = h + m * (1 - z) * (new - h)
                if keep:
                    steps.append((i, h, z, reset, new, r[:, 2 * HIDDEN:], m))
                h = nxt
                out[i] = h
            states.append(out)
            trace[s] = steps
        hid = np.concatenate(states, 2)
        score = np.where(there.T > 0, hid @ p["pool"], -1e9)
        weight = np.exp(score - score.max(0)) * there.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[:, :, None] * hid).sum(0)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (hid, weight, pooled, trace)) if keep else logit

    def backward(self, x, proj, at, dlogit, kept):
        """Gradients of the dense parameters and of the input rows."""
        p, h3 = self.p, 3 * HIDDEN
        hid, weight, pooled, trace = kept
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["out"]
        dweight = (hid * dpool).sum(2)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        g["pool"] = np.einsum("tn,tnh->h", dscore, hid)
        dhid = weight[:, :, None] * dpool + dscore[:, :, None] * p["pool"]
        dproj = np.zeros_like(proj)
        for s, off in (("f", 0), ("b", HIDDEN)):
            dh = np.zeros((len(at), HIDDEN), np.float32)
            du = np.zeros_like(p[f"u{s}"])
            for i, h, z, reset, new, rn, m in reversed(trace[s]):
                dh = dh + dhid[i, :, off:off + HIDDEN]
                dz, dnew = -m * dh * (new - h) * z * (1 - z), m * dh * (1 - z) * (1 - new * new)
                dr = dnew * rn * reset * (1 - reset)
                drec = np.concatenate([dz, dr, dnew * reset], 1)
                du += h.T @ drec
                dh = dh * (1 - m * (1 - z)) + drec @ p[f"u{s}"].T
                own = at[:, i] >= 0
                np.add.at(dproj[:, :h3] if s == "f" else dproj[:, h3:], at[own, i], np.concatenate([dz, dr, dnew], 1)[own])
            g[f"u{s}"] = du
        dx = np.zeros_like(x)
        for s, d in (("f", dproj[:, :h3]), ("b", dproj[:, h3:])):
            g[f"w{s}"], g[f"c{s}"] = x.T @ d, d.sum(0)
            dx += d @ p[f"w{s}"].T
        return g, dx


def _scatter(size: int, rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of gradient rows by table row: the rows touched (not 0) and their sums."""
    order = np.argsort(rows, kind="stable")
    rows, grads = rows[order], grads[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], np.int64)
    sums = np.add.reduceat(grads, first) if len(first) else grads[:0]
    kept = rows[first] > 0
    return rows[first][kept], sums[kept]


class Adam:
    def __init__(self, params):
        self.p, self.t = params, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads, rate):
        """``grads``: name -> full gradient, or (rows, their gradients)."""
        self.t += 1
        fix = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            at, g = g if isinstance(g, tuple) else (slice(None), g)
            m = self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * g
            v = self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * g * g
            self.p[k][at] -= rate * fix * m / (np.sqrt(v) + 1e-8)


def _often(rows_of_texts: list[np.ndarray], size: int) -> np.ndarray:
    """Rows of 0..size-1 that stand in at least LEAST_DOCS texts (each given as its distinct rows)."""
    n = np.zeros(size, np.int64)
    for rows in rows_of_texts:
        n[rows] += 1
    return np.flatnonzero(n >= LEAST_DOCS)


def train(texts: list[list[str]], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Net | None:
    """``texts``: windows of each text, their words joined by spaces.  None without both labels.

    Words become row numbers at once: the driver holds arrays, not strings.
    """
    if len(set(labels)) < 2:
        return None
    seen: dict[bytes, int] = {}
    at = np.full((sum(map(len, texts)), WINDOW), -1, np.int32)
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    for i, window in enumerate(itertools.chain.from_iterable(texts)):
        ws = window.encode("utf-8").split()
        at[i, :len(ws)] = [seen.setdefault(w, len(seen)) for w in ws]
    vocabulary = list(seen)
    seen.clear()
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    ends = np.r_[starts[1:], len(doc)]
    own_words = [np.setdiff1d(at[a:b], [-1]) for a, b in zip(starts, ends)]
    gram_row: dict[bytes, int] = {}
    grams = [np.array([gram_row.setdefault(g, len(gram_row)) for g in grams_of(w)], np.int32) for w in vocabulary]
    own_grams = [np.unique(np.concatenate([grams[w] for w in ws])) if len(ws) else ws for ws in own_words]
    every_gram = list(gram_row)
    net = Net(sorted(vocabulary[i] for i in _often(own_words, len(vocabulary))),
              sorted(every_gram[i] for i in _often(own_grams, len(every_gram))), seed)
    del gram_row, grams, every_gram, own_words, own_grams
    rng = np.random.default_rng(seed)
    adam = Adam(net.p)
    flat = [ws for windows in texts for ws in windows]
    doc = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
    y = np.array(labels, np.float32)
    parts = [net.parts(w) for w in vocabulary]
    for epoch in range(epochs):
        score = rng.random(len(at))
        if epoch:
            score = scores(net, parts, at)
        chosen = []
        for d, (a, b) in enumerate(zip(starts, ends)):
            n = b - a
            top = a + np.argsort(-score[a:b], kind="stable")
            if y[d]:
                chosen += top[:max(1, n // 5) if epoch else 3].tolist()
            else:
                chosen += top[:2].tolist() + rng.integers(a, b, 1).tolist()
        chosen = rng.permutation(chosen)
        for s in range(0, len(chosen), BATCH):
            pick = chosen[s:s + BATCH]
            own, back = np.unique(at[pick], return_inverse=True)
            back = back.reshape(len(pick), WINDOW)
            if len(own) and own[0] == -1:
                own, back = own[1:], back - 1
            x, (rows, grows, owner, scale) = net.inputs([parts[i] for i in own])
            if not len(x):
                continue
            proj = net.project(x)
            logit, kept = net.forward(proj, back, keep=True)
            dlogit = ((sigmoid(logit) - y[doc[pick]]) / len(pick)).astype(np.float32)
            g, dx = net.backward(x, proj, back, dlogit, kept)
            g["word"] = _scatter(len(net.p["word"]), rows, dx[:, :WORD_DIM])
            g["gram"] = _scatter(len(net.p["gram"]), grows, (dx[:, WORD_DIM:] * scale[:, None])[owner])
            adam.step(g, RATE * (1 - 0.8 * epoch / epochs))
    return net


def scores(net: Net, parts, at: np.ndarray, rows: int = 2_048) -> np.ndarray:
    x, _ = net.inputs(parts) if parts else (np.zeros((0, WORD_DIM + CHAR_DIM), np.float32), None)
    proj = net.project(x) if len(x) else np.zeros((1, 6 * HIDDEN), np.float32)
    return np.concatenate([sigmoid(net.forward(proj, at[s:s + rows])) for s in range(0, len(at), rows)])


class _Places(dict):
    """Word -> its row of the projected table; unseen words are given the next row."""

    def __missing__(self, word):
        at = self[word] = len(self)
        return at


class Scorer:
    """Scores whole texts with a trained net; projected words are remembered in a bounded table."""

    def __init__(self, net: Net):
        self.net = net
        self.at = _Places()
        # one table per direction: a batch of windows copies only the rows it reads
        self.table = tuple(np.zeros((MEMO, 3 * HIDDEN), np.float32) for _ in "fb")

    def rows(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.at) > MEMO:
            self.at = _Places()
        old, place = len(self.at), self.at.__getitem__
        got = [np.fromiter(map(place, ws), np.int64, len(ws)) for ws in lists]
        new = len(self.at)
        if new > old:
            fresh = list(itertools.islice(reversed(self.at), new - old))[::-1]
            if new > len(self.table[0]):
                self.table = tuple(np.concatenate([t, np.zeros((new, 3 * HIDDEN), np.float32)]) for t in self.table)
            got_new = self.net.project(self.net.inputs([self.net.parts(w) for w in fresh])[0])
            self.table[0][old:new], self.table[1][old:new] = got_new[:, :3 * HIDDEN], got_new[:, 3 * HIDDEN:]
        return got

    def score(self, texts: list[str]) -> np.ndarray:
        rows = self.rows([words_of(t) for t in texts])
        counts = [len(window_starts(len(r))) for r in rows]
        at = np.full((sum(counts), WINDOW), -1, np.int64)
        k = 0
        for r in rows:
            for s in window_starts(len(r)):
                own = r[s:s + WINDOW]
                at[k, :len(own)] = own
                k += 1
        each = np.concatenate([sigmoid(self.net.forward(self.table, at[s:s + 2_048])) for s in range(0, len(at), 2_048)])
        return np.maximum.reduceat(each, np.cumsum([0, *counts[:-1]]))


def training_sample(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[list[list[str]], list[int]]:
    """Windows and the label of a bounded sample of the labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(crc_mod(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(max_clean))

    def cut(batches):
        for b in batches:
            for i, y, t in zip(*(c.to_pylist() for c in b.columns)):
                ws = words_of(t)
                starts = window_starts(len(ws))
                if len(starts) > MAX_WINDOWS:
                    starts = [starts[k * len(starts) // MAX_WINDOWS] for k in range(MAX_WINDOWS)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i]), pa.array([y], pa.int32()), pa.array([[b" ".join(ws[s:s + WINDOW]).decode() for s in starts]])],
                    names=["doc_id", "toxic", "windows"])

    # the sample is at most max_toxic + max_clean ids: small enough to send to every task
    texts = doc_texts(docs).join(F.broadcast(drawn), "doc_id").select("doc_id", "toxic", "text")
    rows = texts.mapInArrow(cut, "doc_id long, toxic int, windows array<string>").groupBy("doc_id").agg(
        F.first("toxic").alias("toxic"), F.min("windows").alias("windows")).toPandas().sort_values("doc_id")
    return [list(ws) for ws in rows["windows"]], rows["toxic"].tolist()


def score(docs: DataFrame, net: Net | None, toxic_at: float = TOXIC_AT) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(held.value) if held.value else None
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                got = scorer.score(part.column(1).to_pylist()) if scorer else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got.astype(np.float64))], names=["doc_id", "score"])

    scored = doc_texts(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         F.when(F.col("score") >= toxic_at, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, net: Net | None, toxic_at: float = TOXIC_AT, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``toxic_at``."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    at_text = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(held.value) if held.value else None
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                if scorer:
                    got = scorer.score([t or "" for t in part.column(at_text).to_pylist()])
                    part = part.filter(pa.array(got < toxic_at))
                yield part

    return docs.mapInArrow(run, docs.schema)
