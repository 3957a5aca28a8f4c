"""Packing documents into token sequences along a space-filling curve.

Every document is encoded; its tokens are hashed into a signed count vector of
``BUCKETS`` entries, scaled to length one and projected by a fixed Gaussian
matrix to ``DIMS`` numbers.  Their place on the Hilbert curve of a grid of
2^``BITS`` steps a side is the document's key.  A range sort by key gives every
document the number of tokens before it on the curve, and sequences are cut from
that line every ``width`` tokens: neighbours on the curve share sequences, and
no sequence but the last lacks a token.  What is left at the end is cut into
sequences of powers of two, so that nothing is padded at all.

Encoded documents are written once (ids packed in two bytes where the
vocabulary allows).  The sort moves only a row number, the key and the token
count; running sums go range by range, with the ranges' totals (one row each)
as offsets.  The offset then joins the written ids by row number, which is
unique, so no key, copy or source is hot.  A document of any length is encoded
whole.

Cases: a null text is empty and has only its end id; an empty table gives no
rows; rows with equal or null ids or equal texts are documents of their own;
ties on the curve go by row number; other columns are ignored.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from statloom.llm.bpe import PATTERN, byte_letters
from statloom.llm.common import doc_texts, materialize

WIDTH = 2_048
END = 1
BUCKETS = 1_024
DIMS = 4
BITS = 15
SEED = 3
#: Projections beyond this are put on the edge of the grid (they are about normal).
REACH = 4.0
#: Characters without a space, or spaces in a row, from which a text goes to the library, whose merging stays linear.
LONG_RUN = 4_000
#: Rows whose pieces are built together, and their ids.
ROWS = 512
#: Rows of the curve that one task sorts.
RANGE = 1_000_000


class Encoder:
    """Ids of a tokenizer JSON's byte-level BPE, as its library gives them.

    Where the ids count up in the order of the merges (as those of the public
    vocabulary do), an id is a merge rank and the faster rank encoder takes the
    texts; other vocabularies, and texts with very long runs, go to the library.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_str(content)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.ranked = self._ranked(json.loads(content))

    @staticmethod
    def _ranked(spec: dict):
        """The rank encoder, or None where ids are not ranks or more is asked than plain byte-level pre-tokens."""
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        first = [vocab.get(a + b, -1) for a, b in pairs]
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        pre = spec.get("pre_tokenizer") or {}
        if (first != sorted(first) or spec.get("normalizer") or any(pre.get(k) != v for k, v in plain.items())
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])):
            return None
        import tiktoken
        back = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in s): i for s, i in vocab.items() if s not in added}
        if len(pairs) + 256 != len(ranks):
            return None
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or len(text) > LONG_RUN and (
                " " * LONG_RUN in text or max(map(len, text.split(" "))) > LONG_RUN):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.ranked.encode_to_numpy(text, allowed_special="all", disallowed_special=())


_ENCODERS: dict[int, Encoder] = {}


def _encoder(content: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of every row of grid coordinates below 2^bits, as one integer of dims x bits bits.

    From the highest bit down, the sub-cube a point lies in turns or swaps the axes of
    the finer bits; the turned coordinates, Gray-decoded and interleaved, are the place.
    """
    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(dims):
            upper = (x[i] >> b) & 1 == 1
            swap = np.where(upper, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            place = place << 1 | ((c ^ turned) >> b) & 1
    return place


def _hashing(size: int, buckets: int, dims: int, seed: int):
    """Bucket and sign of every token id, and the projection of the buckets."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, buckets, size), rng.choice([-1.0, 1.0], size), rng.standard_normal((buckets, dims))


def _key(ids: np.ndarray, bucket, sign, plane) -> np.ndarray:
    """Grid coordinates of one document; one without tokens lies in the middle."""
    v = np.bincount(bucket[ids], weights=sign[ids], minlength=len(plane))
    norm = np.sqrt(v @ v)
    at = v @ plane / norm if norm else np.zeros(plane.shape[1])
    steps = (1 << BITS) / (2 * REACH)
    return np.clip(np.floor((at + REACH) * steps), 0, (1 << BITS) - 1).astype(np.int64)


def encode(docs: DataFrame, vocabulary: str, end: int | None = END, buckets: int = BUCKETS, dims: int = DIMS,
           seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place (on the curve), n (tokens, with the end id), ids (packed) of every row.

    ``vocabulary`` is the path of a tokenizer JSON on the driver; its content
    (a few MB, whatever the input) is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    held = docs.sparkSession.sparkContext.broadcast(content)
    pack = _packing(content)
    if end is not None and end >= 1 << 16:
        pack = np.uint32
    size = _size(content)

    def run(batches):
        coder = _encoder(held.value)
        hashing = _hashing(size, buckets, dims, seed)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cells, n, packed = [], [], []
                for text in part.column(1):
                    ids = coder.encode(text.as_py())
                    cells.append(_key(ids, *hashing))
                    if end is not None:
                        ids = np.append(ids, np.uint32(end))
                    n.append(len(ids))
                    packed.append(ids.astype(pack).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(hilbert(np.array(cells), BITS), pa.int64()), pa.array(n, pa.int64()),
                     pa.array(packed, pa.binary())], names=["doc_id", "place", "n", "ids"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, place long, n long, ids binary")


def _size(content: str) -> int:
    spec = json.loads(content)
    return 1 + max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])])


def _packing(content: str):
    """Two bytes an id where all ids fit."""
    return np.uint16 if _size(content) <= 1 << 16 else np.uint32


def starts(rows: DataFrame, per_range: int = RANGE) -> DataFrame:
    """row, before: tokens on the curve before each of ``rows`` (row, place, n), and nothing else.

    Ranges of about ``per_range`` rows are written with their number; the sums of the
    ranges, one row each, are the offsets of the running sums inside them.
    """
    spark = rows.sparkSession
    total = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // per_range))
    ranged = materialize(rows.repartitionByRange(parts, "place", "row").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("s")).collect()  # one number for every range
    offset, before = [], 0
    for part, s in sorted(sums):
        offset.append((part, before))
        before += s
    offsets = F.broadcast(spark.createDataFrame(offset, "part int, off long"))
    inside = Window.partitionBy("part").orderBy("place", "row").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.withColumn("upto", F.sum("n").over(inside)).join(offsets, "part").select(
        "row", (F.col("off") + F.col("upto") - F.col("n")).alias("before"))


def _sequence(token: np.ndarray, total: int, width: int):
    """(number, first token, end) of the sequence of each token of the line of ``total`` tokens."""
    whole = total // width
    number = np.minimum(token // width, whole)
    first, stop = number * width, (number + 1) * width
    at, nth = whole * width, whole
    for b in reversed(range((width - 1).bit_length())):
        if (total - whole * width) >> b & 1:
            tail = (token >= at) & (token < at + (1 << b))
            number, first, stop = (np.where(tail, v, x) for v, x in ((nth, number), (at, first), (at + (1 << b), stop)))
            at, nth = at + (1 << b), nth + 1
    return number, first, stop


def pack(coded: DataFrame, width: int = WIDTH, id_bytes: int = 2, per_range: int = RANGE) -> DataFrame:
    """doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece.

    ``coded``: the rows of :func:`encode`, with ids of ``id_bytes`` bytes.
    """
    rows = materialize(coded.withColumn("row", F.monotonically_increasing_id()), compression="zstd")
    total = rows.agg(F.sum("n")).first()[0] or 0
    kind = np.dtype(f"<u{id_bytes}")

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            before, n = (batch.column(i).to_numpy() for i in (1, 2))
            row, start = [], []
            for i, (b, k) in enumerate(zip(before.tolist(), n.tolist())):
                edges = np.arange(b // width * width, b + k, width)
                edges[0] = b
                tail = total // width * width
                if b + k > tail:  # the last tokens of the line, whose sequences are powers of two
                    powers = [1 << p for p in reversed(range(width.bit_length())) if (total - tail) >> p & 1]
                    more = tail + np.cumsum([0, *powers])
                    edges = np.union1d(edges, more[(more > b) & (more < b + k)])
                row.append(np.full(len(edges), i))
                start.append(edges)
            row, start = np.concatenate(row), np.concatenate(start)
            number, first, stop = _sequence(start, total, width)
            stop = np.minimum(stop, (before + n)[row])
            own = start - before[row]
            ids = batch.column(3)
            for s in range(0, len(row), ROWS):
                e = slice(s, s + ROWS)
                pieces = [np.frombuffer(ids[i].as_buffer(), kind, int(k), int(o) * id_bytes).astype("<u4").tobytes()
                          for i, o, k in zip(row[e].tolist(), own[e], (stop - start)[e])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row[e])), pa.array(own[e], pa.int64()),
                     pa.array((stop - start)[e], pa.int64()), pa.array(pieces, pa.binary()), pa.array(n[row[e]], pa.int64()),
                     pa.array(number[e], pa.int64()), pa.array((start - first)[e], pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    placed = rows.select("row", "doc_id", "n", "ids").join(starts(rows.select("row", "place", "n"), per_range), "row")
    return placed.select("doc_id", "before", "n", "ids").mapInArrow(
        cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, width: int = WIDTH, end: int | None = END, **options) -> DataFrame:
    """The pieces of all documents, encoded and packed along the curve."""
    with open(vocabulary, encoding="utf-8") as f:
        small = _packing(f.read()) is np.uint16 and (end is None or end < 1 << 16)
    return pack(encode(docs, vocabulary, end, **options), width, 2 if small else 4)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
