"""SimHash fingerprints and their exact near-duplicate join by binary tries.

Fingerprint: words of the text (ASCII lower-cased) in shingles of three, each
hashed by XXH64; a bit is set if it is set in over half the hashes.  Join: a
binary trie over the distinct fingerprints is joined with itself; pairs of
nodes are followed together from the root down, differing bits add up, and a
pair is dropped as soon as they exceed the budget.

At ``budget`` differing bits, cutting 64 bits into ``budget + 1`` blocks leaves
one block equal, so the trie is built once per block with that block's bits on
top, and only node pairs equal in it are followed: each (block, value) is a
task-sized subtrie.  A subtrie of more than ``UNIT`` fingerprints is split into
pairs of its sub-nodes by the next bits, as often as needed.  A task returns the
star edges of its local components, never all pairs of a dense group.

Cases: a null or blank text has fingerprint zero and links like any other; a
text of one or two words has its whole word sequence as its only shingle;
exact copies (a third of all rows, say) share one fingerprint and meet only in
a partial minimum; rows that share a doc_id are one node; a null
doc_id takes its fingerprint's component; empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import doc_texts, materialize
from statloom.functions.components import connected_components

SHINGLE = 3
SEED = 42
BUDGET = 3
#: Fingerprints that one task joins; larger subtries are split by SPLIT_BITS more bits.
UNIT = 50_000
SPLIT_BITS = 4
#: Fingerprints of a block that one Python call joins about, unit by unit.
BUNDLE = 20_000
#: Node pairs followed at a time inside a task.
CHUNK = 200_000


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.encode("utf-8").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        bits = np.unpackbits(h[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                fps = [fingerprint(t, shingle, seed) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def trie_pairs(left: np.ndarray, right: np.ndarray | None, top: int, budget: int):
    """Index pairs of sorted uint64 keys within ``budget`` differing bits, in chunks.

    ``right`` None: the pairs inside every subtrie of ``left``, keys that agree in
    the first ``top`` bits.  Else ``left`` and ``right`` are one subtrie each.
    """
    same = right is None
    other = left if same else right
    if not len(left) or not len(other):
        return
    high = np.uint64(64 - top)
    if same:
        first = np.flatnonzero(np.r_[True, left[1:] >> high != left[:-1] >> high]) if top else np.array([0])
        last = np.r_[first[1:], len(left)]
        start = np.stack((first, last, first, last, np.zeros_like(first)), 1)
    else:
        start = np.array([[0, len(left), 0, len(other), int(left[0] >> high ^ other[0] >> high).bit_count()]], np.int64)
    stack = [(top, start)]
    while stack:
        depth, p = stack.pop()
        if len(p) > CHUNK:
            half = len(p) // 2
            stack += [(depth, p[:half]), (depth, p[half:])]
            continue
        if depth == 64:
            yield p[:, 0], p[:, 2]
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        clear = ~((bit << np.uint64(1)) - np.uint64(1)) if depth else np.uint64(0)
        a0, a1, b0, b1, d = p.T
        am = np.searchsorted(left, (left[a0] & clear) | bit)
        bm = np.searchsorted(other, (other[b0] & clear) | bit)
        am, bm = np.clip(am, a0, a1), np.clip(bm, b0, b1)
        twin = (a0 == b0) & (a1 == b1) if same else np.zeros(len(p), bool)
        kids = [np.stack(x, 1) for x in ((a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1))]
        kids.append(np.stack((am, a1, b0, bm, d + 1), 1)[~twin])
        kids = np.concatenate(kids)
        kids = kids[(kids[:, 0] < kids[:, 1]) & (kids[:, 2] < kids[:, 3]) & (kids[:, 4] <= budget)]
        if same:  # a single fingerprint with itself is no pair
            kids = kids[(kids[:, 0] != kids[:, 2]) | (kids[:, 1] - kids[:, 0] > 1)]
        if len(kids):
            stack.append((depth + 1, kids))


def star_edges(n: int, pairs) -> np.ndarray:
    """Label per index 0..n-1: the smallest index of its component under the pair chunks."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            la, lb = la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
            a, b = a[apart], b[apart]
    return label


def _rotated(block: int, blocks: int):
    """The fingerprint with its ``block``-th block of bits first."""
    shift = 64 * block // blocks
    if not shift:
        return F.col("fp")
    return F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift))


def linked_fingerprints(fps: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """Edges a, b between the ``node`` values of distinct ``fp`` rows: spanning all pairs within ``budget`` bits."""
    blocks = budget + 1
    width = min(64 * (b + 1) // blocks - 64 * b // blocks for b in range(blocks))
    turned = fps.select("node", F.explode(F.array(*[
        F.struct(F.lit(b).alias("block"), _rotated(b, blocks).alias("key")) for b in range(blocks)])).alias("x")
    ).select("node", "x.block", "x.key")
    # a node pair is (block, p, q): prefixes of `top` bits, p <= q; side 0 lies under p, side 1 under q
    now = turned.withColumns({"p": F.shiftrightunsigned("key", 64 - width), "side": F.lit(0)}).withColumn("q", F.col("p"))
    top, done, keys = width, [], ["block", "p", "q"]
    bundles = max(1, math.ceil(fps.count() / BUNDLE))
    while True:
        now = materialize(now)
        sizes = now.groupBy(*keys).agg(F.count("*").alias("n"), F.max("side").alias("hi"), F.min("side").alias("lo"))
        sizes = sizes.where("n > 1 AND (p = q OR hi > lo)")
        large = materialize(sizes.where(F.col("n") > unit).select(*keys)) if top + SPLIT_BITS <= 64 else None
        rest = now.join(sizes.select(*keys), keys, "left_semi")
        if large is None or large.isEmpty():
            done.append(_join_units(rest, top, budget, bundles))
            break
        done.append(_join_units(rest.join(large, keys, "left_anti"), top, budget, bundles))
        top += SPLIT_BITS
        now = _split(rest.join(large, keys, "left_semi"), top, budget)
    edges = done[0]
    for e in done[1:]:
        edges = edges.unionByName(e)
    return edges


def _split(rows: DataFrame, top: int, budget: int) -> DataFrame:
    """Children of node pairs: the child holding the row against every child within the budget on the other side."""
    masks = F.array(*[F.lit(m) for m in range(1 << SPLIT_BITS) if m.bit_count() <= budget])
    kid = F.shiftrightunsigned("key", 64 - top)
    over = F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p"))  # the prefix of the other side
    low = kid.bitwiseAND(F.lit((1 << SPLIT_BITS) - 1))
    other = F.shiftleft(over, SPLIT_BITS).bitwiseOR(low.bitwiseXOR(F.col("mask").cast("long")))
    out = rows.withColumn("mask", F.explode(masks)).withColumns({"kid": kid, "other": other})
    out = out.where(F.bit_count(F.col("kid").bitwiseXOR(F.col("other"))) <= budget)
    twin = F.col("p") == F.col("q")
    first = F.when(twin, F.col("kid") <= F.col("other")).otherwise(F.col("side") == 0)
    return out.select("node", "block", "key",
                      F.when(first, F.col("kid")).otherwise(F.col("other")).alias("p"),
                      F.when(first, F.lit(0)).otherwise(F.lit(1)).alias("side"),
                      F.when(first, F.col("other")).otherwise(F.col("kid")).alias("q"))


def _join_units(rows: DataFrame, top: int, budget: int, bundles: int) -> DataFrame:
    """Star edges of all units; units of a block are bundled, so that a Python call joins many small ones at once."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        twin = (pdf["p"] == pdf["q"]).to_numpy()
        found = []

        def add(own, cut):
            key, node = own["key"].to_numpy(np.int64).view(np.uint64), own["node"].to_numpy(np.int64)
            if cut is None:
                label = star_edges(len(key), trie_pairs(key, None, top, budget))
            else:
                label = star_edges(len(key), ((a, b + cut) for a, b in trie_pairs(key[:cut], key[cut:], top, budget)))
            tied = np.flatnonzero(label != np.arange(len(key)))
            found.append(pd.DataFrame({"a": node[tied], "b": node[label[tied]]}))

        def ordered(own):
            return own.iloc[np.lexsort((own["key"].to_numpy(np.int64).view(np.uint64), own["side"]))]

        if twin.any():
            add(ordered(pdf[twin]), None)
        for _, own in pdf[~twin].groupby(["p", "q"]):
            add(ordered(own), int((own["side"] == 0).sum()))
        return pd.concat(found)

    bundle = F.pmod(F.xxhash64("p", "q"), F.lit(bundles)).alias("bundle")
    return rows.groupBy("block", bundle).applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, budget: int = BUDGET,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = materialize(fingerprints(docs, shingle, seed, id_col, text_col))
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("node")))
    edges = linked_fingerprints(fps.where("node IS NOT NULL"), budget)
    # equal ids on different fingerprints are one node too
    same = rows.groupBy("doc_id", "fp").agg(F.lit(1)).join(fps, "fp").where("doc_id <> node").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b"))
    shared = rows.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    edges = edges.unionByName(same.join(shared.select(F.col("doc_id").alias("a")), "a", "left_semi"))
    classes = connected_components(edges)
    of_fp = fps.join(classes.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        "fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns: one row of each component of near duplicates stays.

    Rows are told apart by a number given once, not by their id, so rows that share an id
    and rows without one are documents like all others.  The row of the smallest id stays
    (no id last), ties by the hash of all columns.
    """
    key = "_row"
    while key in docs.columns:
        key += "_"
    rows = materialize(docs.withColumn(key, F.monotonically_increasing_id()))
    found = near_duplicates(rows, id_col=key, text_col=text_col, **options).select(
        F.col("doc_id").alias(key), F.col("component_id").alias("_c"))
    order = rows.select(key, F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(
        *[c for c in docs.columns]).alias("h"), F.col(key).alias("r")).alias("_o"))
    heads = found.join(order, key).groupBy("_c").agg(F.min("_o")["r"].alias(key))
    return rows.join(heads.select(key), key, "left_semi").select(*docs.columns)
