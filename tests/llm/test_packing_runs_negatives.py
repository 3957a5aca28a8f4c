"""Packing, periodic runs and hard negatives against the library, brute force and SQL, on small frames."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from statloom.llm import hard_negatives, packing, periodic
from statloom.llm import queries as Q
from statloom.llm.common import read_table
from tests.llm.test_operators import JSON, SF, odd_docs

VEC = "vec_id long, embedding array<double>, label int, score long, x string, leaf int, anchor long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(JSON)
    lib.no_truncation()
    lib.no_padding()
    return lambda text: [*lib.encode(text or "", add_special_tokens=False).ids, 1]


# --- 11: packing ---

def test_encoder_equals_the_library(library):
    with open(JSON, encoding="utf-8") as f:
        coder = packing.Encoder(f.read())
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "'s", "'", "<|endoftext|>", "a", "é", "1", "中", " a", "\r", "\x1c", "!", "the", "\x85", "😀",
             "<|endof", "\xa0", "　", "\x0b", "x" * 80, "​", "́"]
    for _ in range(8_000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert coder.encode(s).tolist() == library(s)[:-1], repr(s)


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_neighbours_are_one_step_apart(dims, bits):
    grid = np.stack([a.ravel() for a in np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")], 1)
    place = packing.hilbert(grid, bits)
    assert sorted(place) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1) == 1).all()


def check_pieces(pieces, documents, width):
    """Pieces tile documents and sequences without gaps; nothing is padded. ``documents``: (id, ids) of every row."""
    total = sum(len(ids) for _, ids in documents)
    by_sequence = {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    filled = 0
    for number, own in sorted(by_sequence.items()):
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == width or (number >= total // width and at & (at - 1) == 0 and at < width)
        filled += at
    assert filled == total
    # rows may repeat: every document's start comes as often as it has rows, and the ids in order are the library's
    whole = {}
    for p in pieces:
        whole.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    left = {}
    for i, ids in documents:
        left.setdefault((i, len(ids)), []).append(ids)
    assert set(whole) == set(left)
    for key, own in whole.items():
        assert sum(p.length for p in own) == key[1] * len(left[key])
        if len(left[key]) == 1:
            own = sorted(own, key=lambda p: p.start)
            assert [p.start for p in own] == [sum(q.length for q in own[:i]) for i in range(len(own))]
            assert [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()] == left[key][0]


def test_packing_on_odd_rows(spark, library):
    docs = odd_docs(spark)
    want = [(r.doc_id, library(r.text)) for r in docs.collect()]
    for width in (2_048, 16, 7):
        coded = packing.encode(docs, JSON)
        pieces = packing.pack(coded, width, per_range=3).collect() if width > 7 else packing.pack(coded, 8).collect()
        check_pieces(pieces, want, width if width > 7 else 8)


def test_packing_query(spark, library):
    docs = read_table(spark, SF, "documents")
    want = [(r.doc_id, library(r.text)) for r in docs.collect()]
    check_pieces(packing.pack_documents(docs, JSON).collect(), want, 2_048)
    got = Q.op11_packing(spark, SF).collect()
    ids = dict(want)
    for p in got:
        piece = np.array(ids[p.doc_id][p.start:p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(piece) and p.doc_tokens == len(ids[p.doc_id])
    assert sum(p.length for p in got) == sum(len(x) for x in ids.values())


def test_alike_documents_are_neighbours(spark):
    topics = ["red green blue colour paint brush", "tax law court judge appeal case", "goal match team league score win"]
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(topics[i % 3].split()) for _ in range(200))) for i in range(90)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), JSON, 1_024).collect()
    line = sorted(((p.sequence_id, p.offset, p.doc_id % 3) for p in pieces if p.start == 0))
    changes = sum(a[2] != b[2] for a, b in zip(line, line[1:]))
    assert changes < 30  # about 60 in random order


def test_packing_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, row long")
    assert packing.digests(packing.pack_documents(empty, JSON)).count() == 0


# --- 12: periodic runs ---

def runs_by_lags(w):
    """Every lag, word by word; a stretch counts if no shorter period holds in it."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(
                    all(w[x] == w[x + p] for x in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(i + 1, j)
    return sorted(out)


def random_words(rng, n):
    """Words with planted runs, some of them periodic within their period."""
    w = [rng.randrange(rng.choice([1, 2, 3, 1000])) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        s = rng.randrange(n)
        block = w[s:s + rng.randint(1, max(1, (n - s) // 3))]
        if len(block) > 4 and rng.random() < 0.6:
            d = rng.randint(1, len(block) // 2)
            block = [block[i % d] for i in range(len(block) - 1)] + [rng.randrange(5)]
        for i in range(s, rng.randint(s, n)):
            w[i] = block[(i - s) % len(block)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        texts = [random_words(rng, rng.choice([1, 5, 60, 200, 500])) for _ in range(4)] + [[]]
        got = periodic.find_runs([np.array(t, np.int64) for t in texts])
        assert got == [runs_by_lags(t) for t in texts]


def test_long_periods_are_found():
    rng = np.random.default_rng(4)
    block = rng.integers(0, 1000, 5_003)
    w = np.concatenate([rng.integers(0, 1000, 777), np.tile(block, 5)[:4 * 5_003 + 11], [-5], rng.integers(0, 1000, 99)])
    [(start, length, period)] = periodic.find_runs([w])[0]
    assert (period, length) == (5_003, 4 * 5_003 + 11) and start == 777
    assert periodic.find_runs([np.zeros(200_000, np.int64)])[0] == [(0, 200_000, 1)]


def expected(doc_id, text):
    """The contract, word by word."""
    words = [w for w in (text or "").encode().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    numbers = {}
    runs = runs_by_lags([numbers.setdefault(w, len(numbers)) for w in words])
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def digest_rows(df):
    return sorted((tuple(r[c] for c in ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                        "collapsed_sha256"]) for r in df.collect()), key=str)


def test_periodic_on_odd_rows(spark):
    docs = odd_docs(spark).where("doc_id <> 6 OR doc_id IS NULL")
    more = [(10 + i, f"{'x y ' * i}z\x0b{'a b c d ' * (i % 7)}\x1c \x85 é", None, *["x"] * 12) for i in range(40)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = digest_rows(periodic.digests(periodic.detect(periodic.planted(docs))))
    assert got == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=str)
    long = periodic.digests(periodic.detect(odd_docs(spark).where("doc_id = 6"))).first()
    assert (long.n_runs, long.start, long.length, long.period, long.exponent_milli) == (1, 0, 30_000, 1, 30_000_000)
    assert long.collapsed_sha256 == hashlib.sha256(b"word").hexdigest()
    assert periodic.digests(periodic.detect(docs.limit(0))).count() == 0


def test_periodic_query(spark):
    short = read_table(spark, SF, "documents").where("n_chars < 4000")
    got = {r[0]: r for r in digest_rows(Q.op12_periodic(spark, SF))}
    rows = short.collect()
    assert rows and len(got) == read_table(spark, SF, "documents").count()
    for r in rows:
        assert got[r.doc_id] == expected(r.doc_id, r.text)


# --- 13: hard negatives ---

def mined(rows, anchors, k=5):
    """Every pair, in whole numbers."""
    fit = {(i, label, tuple(int(np.floor(256 * float(c))) for c in v)) for i, v, label in rows
           if i is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    out = []
    for a, label, x in [f for f in fit if f[0] in anchors]:
        near = sorted((-sum(map(int.__mul__, x, y)), i, other) for i, other, y in fit if i != a and len(y) == len(x))
        for s, p, _ in [n for n in near if n[2] == label][:k]:
            hard = [n for n in near if n[2] != label and 80 * -s <= 100 * -n[0] <= 100 * -s][:k]
            out += [(a, p, r + 1, n[1], -s, -n[0]) for r, n in enumerate(hard)]
    return sorted(out)


def negative_rows(df):
    cols = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", 2, 3) for i, v, label in rows], VEC)


@pytest.mark.parametrize("dims,spread", [(2, 0.0), (6, 1.0)])
def test_negatives_equal_brute_force(spark, dims, spread):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(8, dims)) * 2
    rows = [(i, (centres[rng.integers(8)] + spread * rng.normal(size=dims) * 0.3).round(2).tolist(), int(rng.integers(4)))
            for i in range(700)]
    df = frame(spark, rows)
    anchors = {i for i in range(0, 700, 20)}
    got = negative_rows(hard_negatives.mine(df, df.where("vec_id % 20 = 0"), sample=300, leaf=10, fanout=4, block=64))
    assert got == mined(rows, anchors)
    assert got


def test_subtrees_are_left_out():
    rng = np.random.default_rng(0)
    x = np.floor(256 * (np.repeat(rng.normal(size=(20, 8)) * 3, 50, 0) + 0.05 * rng.normal(size=(1_000, 8))))
    tree = hard_negatives.Tree(x[::3], fanout=6, leaf=20)
    ranges, norms = {}, {}
    for leaf, rows, seen in tree.route(x):
        size = np.sqrt((x[rows] ** 2).sum(1))
        norms[leaf] = (size.min(), size.max())
        ranges.update({(leaf, n, s): (v[:, s].min(), v[:, s].max()) for n, v in seen.items() for s in range(v.shape[1])})
    tree.fill(ranges, norms)
    members = {leaf: rows for leaf, rows, _ in tree.route(x)}
    opened = 0
    for a in x[::50]:
        s = x @ a
        low = np.sort(s)[-8]
        got = {leaf for _, leaf in tree.search(a, (low, np.inf))}
        assert {leaf for leaf, rows in members.items() if (s[rows] >= low).any()} <= got
        opened += len(got)
    assert opened < 20 * len(members) / 4


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [1.0, 0.4], 2), (3, [0.9, 0.5], 2), (4, None, 1),
            (5, [None, 1.0], 2), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2), (8, [1.0, 0.5], None),
            (None, [1.0, 0.5], 2), (9, [0.0, 0.0], 2), (10, [], 1), (11, [], 2), (12, [1.0, 0.5, 2.0], 2), (20, [-1.0, -1.0], 3),
            (40, [1.0, 0.5], 4), (60, [], 1), (3, [0.95, 0.5], 2), (80, [3e9, -2e9], 1), (81, [3e9, -2e9], 1), (82, [2.9e9, -2e9], 2)]
    df = frame(spark, rows)
    got = negative_rows(hard_negatives.mine(df, df.where("vec_id % 20 = 0")))
    assert got == [tuple(min(v, 2 ** 63 - 1) if i > 3 else v for i, v in enumerate(r)) for r in mined(rows, {0, 20, 40, 60, 80})]
    huge = frame(spark, [(0, [1e300, 1.0], 1), (1, [1e300, 2.0], 1), (2, [1e300, 0.0], 2), (3, [-1e300, 0.0], 2)])
    out = negative_rows(hard_negatives.mine(huge, huge.where("vec_id = 0"), leaf=1, fanout=2))
    assert out == [(0, 1, 1, 2, 2 ** 63 - 1, 2 ** 63 - 1)]
    assert hard_negatives.mine(df.limit(0), df.limit(0)).count() == 0
    assert hard_negatives.mine(df, df.where("vec_id = 999")).count() == 0


def test_negatives_query_equals_sql(spark, duck):
    cur = duck.execute(Q.SQL["op13_negatives"])
    names = [d[0] for d in cur.description]
    got = Q.op13_negatives(spark, SF)
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(dict(zip(names, r))[c] for c in ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                                         "negative_score"]) for r in cur.fetchall())
    assert negative_rows(got) == want and want
