"""SimHash near-duplicates by a Gray-order hierarchical index of fingerprints.

Distinct fingerprints are dealt into blocks by segments of their bits: fingerprints that differ in at most d
bits agree on one of d + 1 segments. A block sorts its fingerprints by Gray rank, which puts similar ones next
to each other, and builds a tree over the sorted list: a node holds the bits that all fingerprints under it
share and that no node above holds. A search carries the differences counted so far and drops a node, with all
under it, once they exceed d. A block that is too large for one task is dealt again by segments of the bits
that it does not share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm import common
from verdigraph.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Children of an index node.
FANOUT = 8
#: Fingerprints that one task searches together; larger blocks are dealt again.
BLOCK_ROWS = 200_000
_SEARCHED = 4096


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the XXH64 hashes of the word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(whole[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp long) of every row of docs; a null text counts as empty and has fingerprint 0."""

    def run(batches):
        for batch in batches:
            data, at = common.utf8(batch.column(1))
            raw, at = memoryview(data), at.tolist()
            fps = np.array([fingerprint(bytes(raw[s:e]), shingle) for s, e in zip(at[:-1], at[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    out = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """A tree over fingerprints in Gray order; levels run from the leaves to the root."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT) -> None:
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        self.fanout = fanout
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        values, masks = self.codes, np.full(len(codes), full, np.uint64)
        self.values, self.masks = [values], [masks]
        while len(values) > 1:
            first = np.arange(0, len(values), fanout)
            ones = np.bitwise_and.reduceat(values, first)
            zeros = np.bitwise_and.reduceat(~values, first)
            shared = (ones | zeros) & np.bitwise_and.reduceat(masks, first)
            values, masks = ones & shared, shared
            self.values.append(values)
            self.masks.append(masks)
        for level in range(len(self.masks) - 1):  # a node keeps the bits that no node above it holds
            above = self.masks[level + 1][np.arange(len(self.masks[level])) // fanout]
            self.masks[level] = self.masks[level] & ~above
        self.values = [v & m for v, m in zip(self.values, self.masks, strict=True)]

    def search(self, queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, place in codes) that differ in at most `distance` bits."""
        who = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        spent = np.zeros(len(queries), np.int64)
        for level in range(len(self.values) - 1, -1, -1):
            spent = spent + np.bitwise_count((queries[who] ^ self.values[level][node]) & self.masks[level][node])
            kept = spent <= distance
            who, node, spent = who[kept], node[kept], spent[kept]
            if level:
                who, spent = np.repeat(who, self.fanout), np.repeat(spent, self.fanout)
                node = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                inside = node < len(self.values[level - 1])
                who, node, spent = who[inside], node[inside], spent[inside]
        return who, node


def forest(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, other) that connect exactly what pairs of codes within `distance` connect, one a code at most."""
    index = GrayIndex(codes)
    label = np.arange(len(codes))
    for at in range(0, len(codes), _SEARCHED):
        who, found = index.search(index.codes[at : at + _SEARCHED], distance)
        a, b = who + at, found
        keep = a < b
        a, b = a[keep], b[keep]
        while len(a):
            while not np.array_equal(label, up := label[label]):
                label = up
            x, y = label[a], label[b]
            open_ = x != y
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    while not np.array_equal(label, up := label[label]):
        label = up
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return index.codes[moved], index.codes[label[moved]]


def _segments(mask: int, parts: int) -> list[int]:
    """Masks of `parts` runs of the bits in `mask`, sizes as even as can be."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(1 << b for b in bits[s:e]) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(codes: DataFrame, distance: int = DISTANCE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b) over distinct `fp` values: links that connect exactly what pairs within `distance` bits connect.

    A pair of fingerprints meets in every block whose segment they share. The blocks of a round that hold more
    than block_rows fingerprints are dealt again over their other bits, until blocks fit or share all but
    a few bits, which bounds them by themselves.
    """

    def run(batches):
        parts = [(b.column("seg").to_numpy(), b.column("value").to_numpy(), b.column("fp").to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        seg, value, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((value, seg))
        seg, value, fp = seg[order], value[order], fp[order].view(np.uint64)
        first = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (value[1:] != value[:-1])])
        last = np.r_[first[1:], len(fp)]
        a, b = [], []
        pairs = last - first == 2  # most blocks; no tree is needed
        x, y = fp[first[pairs]], fp[first[pairs] + 1]
        near = np.bitwise_count(x ^ y) <= distance
        a.append(x[near])
        b.append(y[near])
        for s, e in zip(first[last - first > 2].tolist(), last[last - first > 2].tolist(), strict=True):
            p, q = forest(fp[s:e], distance)
            a.append(p)
            b.append(q)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    found = None
    dealt = codes.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).alias("free"))
    trees = {0: (1 << 64) - 1}
    while True:
        cuts = {k: _segments(m, distance + 1) for k, m in trees.items()}
        nexts, exploded, n = {}, [], 0
        for k, segments in cuts.items():
            for s in segments:
                nexts[n] = trees[k] & ~s
                exploded.append((k, n, s))
                n += 1
        pick = F.array(*(F.struct(F.lit(k).alias("free"), F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(_signed(s))).alias("value")) for k, i, s in exploded))
        rows = dealt.select("fp", "path", F.explode(F.filter(pick, lambda x: x["free"] == F.col("free"))).alias("x"))
        # a block is named by a hash of all segments on the way to it; blocks that share a name are merely searched together
        rows = rows.select("fp", F.xxhash64("path", "x.seg", "x.value").alias("path"), F.col("x.seg").alias("seg"))
        hot = rows.groupBy("path").count().where(F.col("count") > block_rows).select("path")
        hot = common.staged(hot, "hot-blocks")
        deeper = not hot.isEmpty() and all(bin(m).count("1") > 12 for m in nexts.values())
        now = rows.join(hot, "path", "left_anti") if deeper else rows
        now = now.repartition(F.col("path")).select("seg", F.col("path").alias("value"), "fp").mapInArrow(run, "a long, b long")
        found = now if found is None else found.unionByName(now)
        if not deeper:
            return found
        dealt = common.staged(rows.join(hot, "path", "left_semi").select("fp", "path", F.col("seg").alias("free")), "hot-block-rows")
        trees = nexts


def classes(docs: DataFrame, key: str = "doc_id", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component) of every row of docs; component is the smallest key that links reach, itself included.

    Rows with equal texts always share a component. Null keys never name a component unless it has no other.
    Texts without words have fingerprint 0 and link like any other. Repeated rows stay.
    """
    rows = common.staged(fingerprints(docs, key, shingle), "fingerprints")
    codes = common.staged(rows.groupBy("fp").agg(F.min(key).alias("least")), "codes")
    roots = components(links(codes, distance))
    named = codes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = common.staged(named, "rooted-codes")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(least, "root").select("fp", "component")
    return rows.join(named, "fp").select(key, "fp", "component")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs."""
    out = classes(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: the one whose doc_id names it (of repeated rows with that doc_id, one).

    Rows without a doc_id are all kept, as nothing tells them apart.
    """
    named = classes(docs, "doc_id", distance).where("doc_id = component").select("doc_id").distinct()
    first = docs.join(named, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return first.unionByName(docs.where("doc_id is null"))
