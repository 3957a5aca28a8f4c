"""Byte-level BPE encoding and decoding.

Encoding keeps the symbols of a pre-token in a doubly linked list and a
priority queue of (merge rank, position) over its adjacent pairs.  The lowest
rank is merged first, leftmost on ties; an entry whose pair has changed since
it was queued is stale and skipped.  Decoding concatenates the vocabulary
strings of the ids (as bytes, then UTF-8).

Cases: a null text is the empty text (no ids, decoded empty).  Texts of any
length are encoded whole.  Repeated rows give repeated results, an empty table
an empty one.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statloom.llm.common import doc_texts

#: Fixed value: the byte-level pre-token pattern.
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")

#: Coarser cut of the same text: a non-space run with the one space before it, else a run of spaces.
#: Every pre-token lies inside one such chunk and starts matching at its start.
CHUNK = r" ?\S+|\s+(?!\S)|\s+"
#: Control characters that ``re`` counts as white space and the pattern does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")

#: Chunks, and pre-tokens, remembered by one Python worker (two generations of this size).
MEMO = 250_000

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()),
                       T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                       T.StructField("decoded", T.StringType())])


def byte_letters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary (a tokenizer JSON's content)."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.strings = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in s)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.added.items():
            self.strings[i] = s.encode()
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.pre_tokens = regex.compile(PATTERN).findall
        self.chunks = re.compile(CHUNK).findall
        self.memo = _Memo(lambda token: array("i", self.merge(token)).tobytes())
        self.chunk_memo = _Memo(lambda chunk: b"".join([self.memo[w] for w in self.pre_tokens(chunk)]))

    def merge(self, token: str) -> list[int]:
        """Ids of one pre-token."""
        byte_ids, merges = self.byte_ids, self.merges
        ids = [byte_ids[b] for b in token.encode("utf-8")]
        n = len(ids)
        queue = []  # rank and position in one integer, so that entries compare fast
        for i in range(n - 1):
            m = merges.get((ids[i], ids[i + 1]))
            if m:
                queue.append(m[0] << 40 | i)
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFFFF
            j = after[i]
            if j >= n:
                continue
            m = merges.get((ids[i], ids[j]))
            if not m or m[0] != entry >> 40:
                continue  # stale: one of the two symbols has been merged meanwhile
            ids[i], ids[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get((ids[i], ids[k]))
                if m:
                    push(queue, m[0] << 40 | i)
            h = before[i]
            if h >= 0:
                m = merges.get((ids[h], ids[i]))
                if m:
                    push(queue, m[0] << 40 | h)
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return b"".join([self.memo[w] for w in self.pre_tokens(text)])
        memo = self.chunk_memo
        return b"".join([memo[w] for w in self.chunks(text)])

    def encode(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.added):
            return np.frombuffer(self._plain(text), np.int32)
        parts = [np.int32(self.added[p]).tobytes() if p in self.added else self._plain(p)
                 for p in self.cut.split(text)]
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        strings = self.strings
        return b"".join([strings[i] for i in ids]).decode("utf-8", "replace")


class _Memo(dict):
    """Piece of text -> its ids as int32 bytes; at most two generations of ``MEMO`` entries."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, token):
        got = self.old.get(token)
        if got is None:
            got = self.make(token)
        if len(token) <= 64:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[token] = got
        return got


_CODECS: dict[str, Codec] = {}


def _codec(content: str) -> Codec:
    """One codec per Python worker and vocabulary."""
    key = str(hash(content))
    if key not in _CODECS:
        _CODECS[key] = Codec(json.loads(content))
    return _CODECS[key]


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of every whole text.

    ``vocabulary`` is the path of a tokenizer JSON on the driver; its content
    (a few MB, whatever the input) is broadcast.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    held = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        codec = _codec(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                decoded = [codec.decode(x.tolist()) for x in ids]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                values = pa.array(np.concatenate(ids), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "decoded"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def digests(coded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 of ids and decoded text, computed by Spark from the operator's rows."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(ids, 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
