"""Documents whose sets of word shingles are similar, joined by signature trees.

Equal sets are one node. Nodes whose Jaccard similarity can reach the threshold share a shingle among the first few of
each when shingles are ordered from rare to common, so a shingle's nodes form a block. First, nodes with an equal
min-hash are compared with one of them, which joins most groups of near copies cheaply. A block that has nodes of more
than one group left then gets a signature tree: its leaves are nodes, and an upper node holds the OR of their token
bitmaps, the range of their sizes and of their groups. Pairs of tree nodes are traversed from the root down; a pair goes
when the largest overlap that its bitmaps and sizes allow is too small, or when all below it is one group already. The
pairs of leaves that are left are compared by their whole sets: in the first rounds each node's most promising one, which
soon makes one group of near copies, and in the last round all that still join two groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm import common
from verdigraph.llm.components import components

SHINGLE = 4
#: Least similarity, in hundredths.
PERCENT = 85
#: Shingles are counted in this many bins, which decide what is rare; the counts are broadcast (2 MB).
BINS = 1 << 18
#: Bits of a token bitmap.
BITS = 1024
#: Min-hashes of the first comparison.
HEADS = 4
FANOUT = 8
#: Nodes that one task compares together; larger blocks are dealt over several tasks.
BLOCK_ROWS = 20_000
#: Blocks of so few nodes are compared without a tree.
_SMALL = 16
#: Most rows that are broadcast to find the documents of a comparison; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rounds of best pairs go on while one in so many of their pairs is a link.
ENOUGH = 4
_SLICE = 1 << 15
_WORD = ~common.SPACES


def _mixed(values: np.ndarray, seed: int) -> np.ndarray:
    return common.mix(values ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))


def shingle_sets(text: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of texts in turn: the hashes of all shingles, distinct and ascending within a text, and each text's bounds.

    A text with fewer words than a shingle has one hash, a text without words none.
    """
    data, offsets = common.utf8(text)
    for first, last in common.chunks(offsets):
        for low in range(first, last, 4096):  # bounds what many tiny texts take
            high = min(last, low + 4096)
            own = common.LOWER[data[offsets[low] : offsets[high]]]
            starts, ends, docs = common.spans(own, offsets[low : high + 1] - offsets[low], _WORD)
            at = np.searchsorted(docs, np.arange(high - low + 1))
            words = common.word_hashes(own, starts, ends)
            begin, grams = common.sequence_hashes(words, docs, shingle)
            short = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < shingle))
            who = np.concatenate([docs[begin], short])
            grams = np.concatenate([grams, common.run_hashes(words, at[short], at[short + 1])])
            order = np.lexsort((grams, who))
            who, grams = who[order], grams[order]
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (grams[1:] != grams[:-1])
            yield grams[new], np.searchsorted(who[new], np.arange(high - low + 1))


def _bin(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)


def bin_counts(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """How many documents have a shingle of each bin, over all documents; BINS numbers whatever the size of docs."""

    def run(batches):
        counts = np.zeros(BINS, np.int64)
        for batch in batches:
            for grams, _ in shingle_sets(batch.column(0), shingle):
                counts += np.bincount(_bin(grams), minlength=BINS)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met])], names=["bin", "n"])
        common.trimmed()

    out = np.zeros(BINS, np.int64)
    for r in docs.select("text").mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        out[r["bin"]] = r["n"]
    return out


def _node_names(grams: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits that name a set; None for the empty set."""
    full = np.flatnonzero(np.diff(at))
    sums = np.stack([np.add.reduceat(_mixed(grams, seed), at[full]) for seed in (101, 102)], axis=1) if len(full) else np.zeros((0, 2), np.uint64)
    out: list[bytes | None] = [None] * (len(at) - 1)
    for i, s in zip(full.tolist(), sums, strict=True):
        out[i] = s.tobytes()
    return out


def _bitmaps(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    bits = np.zeros((len(at) - 1, BITS), bool)
    bits[np.repeat(np.arange(len(at) - 1), np.diff(at)), (grams & np.uint64(BITS - 1)).astype(np.int64)] = True
    return [b.tobytes() for b in np.packbits(bits, axis=1, bitorder="little")]


def _wide_bitmaps(grams: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Bitmaps that grow with their sets: four bits an element at least, a power of two."""
    out = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        bits = np.zeros(max(BITS, 1 << max(0, 4 * (e - s) - 1).bit_length()), bool)
        bits[(grams[s:e] & np.uint64(len(bits) - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
    return out


def _may_be_similar(x: bytes, n: int, y: bytes, m: int, percent: int) -> bool:
    """The bound of two sets by their wide bitmaps, the longer one folded to the length of the other."""
    p, q = (np.frombuffer(b, np.uint64) for b in (x, y))
    width = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(b.reshape(-1, width), axis=0) for b in (p, q))
    shared = int(np.bitwise_count(p & q).sum())
    overlap = min(n - int(np.bitwise_count(p).sum()), m - int(np.bitwise_count(q).sum())) + shared
    return (100 + percent) * min(overlap, n, m) >= percent * (n + m)


def prefix_length(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many first shingles of a set hold one at least that any similar set has among its own first ones."""
    return np.where(sizes > 0, sizes - (sizes * percent + 99) // 100 + 1, 0)


def signed(docs: DataFrame, key: str, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """(key, n, node, heads, tokens, bits, wide) of every row: size and name of its set, min-hashes, first shingles, bitmaps."""
    sent = docs.sparkSession.sparkContext.broadcast(bin_counts(docs, shingle))

    def run(batches):
        for batch in batches:
            n, nodes, heads, tokens, bits, wide = [], [], [], [], [], []
            for grams, at in shingle_sets(batch.column(1), shingle):
                sizes = np.diff(at)
                who = np.repeat(np.arange(len(sizes)), sizes)
                rare = np.lexsort((grams, sent.value[_bin(grams)], who))
                first = np.arange(len(grams)) - at[who] < prefix_length(sizes, percent)[who]
                full = np.flatnonzero(sizes)
                least = np.stack([np.minimum.reduceat(_mixed(grams, s), at[full]) for s in range(HEADS)], axis=1) if len(full) else np.zeros((0, HEADS), np.uint64)
                n.append(sizes)
                nodes += _node_names(grams, at)
                heads.append((np.where(sizes > 0, HEADS, 0), least.ravel()))
                tokens.append((prefix_length(sizes, percent), grams[rare][first]))
                bits += _bitmaps(grams, at)
                wide += _wide_bitmaps(grams, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(nodes, pa.binary()), _lists(heads), _lists(tokens), pa.array(bits, pa.binary()), pa.array(wide, pa.binary())], names=[key, "n", "node", "heads", "tokens", "bits", "wide"])
        common.trimmed()

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, n long, node binary, heads array<long>, tokens array<long>, bits binary, wide binary")


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    sizes, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values.view(np.int64)))


class SignatureTree:
    """Levels from the leaves to the root; leaves stand in order of size and group."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, groups: np.ndarray, height: int = 1, fanout: int = FANOUT) -> None:
        self.order = np.lexsort((groups, sizes))
        self.fanout = fanout
        bits, low, groups = bits[self.order], sizes[self.order], groups[self.order]
        high, slack, first, last = low, low - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), groups, groups
        self.levels = [(bits, low, high, slack, first, last)]
        while len(bits) > 1 or len(self.levels) < height:
            at = np.arange(0, len(bits), fanout)
            bits = np.bitwise_or.reduceat(bits, at, axis=0)
            low, first = np.minimum.reduceat(low, at), np.minimum.reduceat(first, at)
            high, slack, last = (np.maximum.reduceat(x, at) for x in (high, slack, last))
            self.levels.append((bits, low, high, slack, first, last))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Child numbers of each node, and which of them exist."""
        down = nodes[:, None] * self.fanout + np.arange(self.fanout)
        return down, down < len(self.levels[level - 1][1])


def _margin(x: tuple, p: np.ndarray, y: tuple, q: np.ndarray, percent: int) -> np.ndarray:
    """By how much the best pair below nodes p and q can exceed the threshold; below 0 if it can't, or joins no two groups.

    A set has no more elements in another than the bits they share and its elements beyond its own bits, and no more
    than either has. Between leaves this is the bound of that pair.
    """
    shared = np.bitwise_count(x[0][p] & y[0][q]).sum(axis=1, dtype=np.int64)
    overlap = np.minimum(np.minimum(x[3][p], y[3][q]) + shared, np.minimum(x[2][p], y[2][q]))
    one = (x[4][p] == x[5][p]) & (y[4][q] == y[5][q]) & (x[4][p] == y[4][q])
    both = x[1][p] + y[1][q]
    return np.where(one, -1.0, ((100 + percent) * overlap - percent * both) / np.maximum(both, 1))


def traverse(left: SignatureTree, right: SignatureTree, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (of left, of right) of the pairs that remain; within one tree every pair once."""
    own = left is right
    top = len(left.levels) - 1
    start = np.zeros(1, np.int64)
    stack = [(top, start, start)]
    while stack:
        level, p, q = stack.pop()
        if len(p) > _SLICE:
            stack += [(level, p[i : i + _SLICE], q[i : i + _SLICE]) for i in range(0, len(p), _SLICE)]
            continue
        keep = _margin(left.levels[level], p, right.levels[level], q, percent) >= 0
        p, q = p[keep], q[keep]
        if not len(p):
            continue
        if not level:
            yield left.order[p], right.order[q]
            continue
        a, a_in = left.children(level, p)
        b, b_in = right.children(level, q)
        inside = a_in[:, :, None] & b_in[:, None, :]
        if own:
            inside &= (a[:, :, None] < b[:, None, :]) | (a[:, :, None] == b[:, None, :]) & (level > 1)
        row, i, j = np.nonzero(inside)
        stack.append((level - 1, a[row, i], b[row, j]))


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int, best_only: bool) -> Iterator[pa.RecordBatch]:
    """(a, b) of the blocks of a partition: rows (block, side, id, comp, n, bits); side 0 is compared within itself, 1 with 2.
    best_only leaves each row's most promising pair."""

    def sent(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    block, side, ids, comp, n = (table.column(c).to_numpy() for c in ("block", "side", "id", "comp", "n"))
    bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
    order = np.lexsort((side, block))
    block, side, ids, comp, n, bits = block[order], side[order], ids[order], comp[order], n[order], bits[order]
    leaf = (bits, n, n, n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64), comp, comp)
    best, partner = np.full(len(block), -1.0), np.full(len(block), -1)

    for p, q in _row_pairs(block, side, leaf, percent):
        if not best_only:
            yield sent(ids[p], ids[q])
            continue
        margin = _margin(leaf, p, leaf, q, percent)
        for x, y in ((p, q), (q, p)):
            better = np.flatnonzero(margin > best[x])
            better = better[np.argsort(margin[better], kind="stable")]  # of a row's pairs the last one, the best, is what stays
            best[x[better]], partner[x[better]] = margin[better], y[better]
    x = np.flatnonzero(partner >= 0)
    yield sent(ids[x], ids[partner[x]])
    common.trimmed()


def _row_pairs(block: np.ndarray, side: np.ndarray, leaf: tuple, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows, in order of block and side, that may be similar."""
    bits, n, comp = leaf[0], leaf[1], leaf[4]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    size = np.diff(np.r_[first, len(block)])
    small = (size <= _SMALL) & (side[first] == 0)
    end = np.repeat(np.where(small, first + size, 0), size)  # of a row's block, 0 in large ones
    at = np.arange(len(block))
    for step in range(1, _SMALL):
        for low in range(0, len(at), 1 << 18):
            p = at[low : low + (1 << 18)]
            p = p[p + step < end[p]]
            p = p[_margin(leaf, p, leaf, p + step, percent) >= 0]
            yield p, p + step
    for s, e in zip(first[~small].tolist(), (first + size)[~small].tolist(), strict=True):
        cut = s + int(np.searchsorted(side[s:e], 2))
        if side[s] == 0:
            tree = SignatureTree(bits[s:e], n[s:e], comp[s:e])
            yield from ((s + p, s + q) for p, q in traverse(tree, tree, percent))
        elif s < cut < e:
            height = max(len(SignatureTree(bits[x:y], n[x:y], comp[x:y]).levels) for x, y in ((s, cut), (cut, e)))
            one, two = (SignatureTree(bits[x:y], n[x:y], comp[x:y], height) for x, y in ((s, cut), (cut, e)))
            yield from ((s + p, cut + q) for p, q in traverse(one, two, percent))


def dealt(blocks: DataFrame, most: int = BLOCK_ROWS) -> DataFrame:
    """(block, side, id, comp, n) of rows (token, id, comp, n, rows): the blocks that tasks compare.

    A block of at most `most` rows stays whole. A larger one is cut into pieces, a large group into pieces of its own and
    the rest by group, and every pair of pieces meets but for two pieces of one group.
    """
    whole = blocks.where(F.col("rows") <= most).select(F.col("token").alias("block"), F.lit(0).alias("side"), "id", "comp", "n")
    large = blocks.where(F.col("rows") > most)
    if large.isEmpty():
        return whole
    groups = large.groupBy("token", "comp").agg(F.count("*").alias("same"), F.first("rows").alias("rows"))
    of_one = F.col("same") > most // 2
    groups = groups.select(
        "token", "comp", F.when(of_one, F.col("comp")).alias("solo"), F.ceil(F.when(of_one, F.col("same")).otherwise(F.col("rows")) / most).alias("cuts")
    )
    spread = F.pmod(F.xxhash64(F.when(F.col("solo").isNull(), F.col("comp")).otherwise(F.col("id"))), F.col("cuts"))
    pieces = common.staged(large.join(groups, ["token", "comp"]).withColumn("piece", F.xxhash64("token", "solo", spread)), "jaccard-pieces")
    known = common.staged(pieces.select("token", "piece", "solo").distinct(), "jaccard-piece-list")
    other = known.select("token", F.col("piece").alias("other"), F.col("solo").alias("other_solo"))
    met = known.join(other, "token").where("piece <= other and coalesce(solo <> other_solo, true)")
    met = met.select("token", F.xxhash64("token", "piece", "other").alias("block"), F.explode(F.when(F.col("piece") == F.col("other"), F.array(F.struct(F.col("piece"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("piece"), F.lit(1).alias("side")), F.struct(F.col("other").alias("piece"), F.lit(2).alias("side"))))).alias("x"))
    met = met.select("token", "block", "x.piece", "x.side")
    return whole.unionByName(pieces.join(met, ["token", "piece"]).select("block", "side", "id", "comp", "n"))


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of node ids that the bound by their wide bitmaps leaves."""
    one, two = (nodes.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("wide").alias(f"{c}_wide")) for c in ("a", "b"))

    def run(batches):
        for batch in batches:
            x, n, y, m = (batch.column(c).to_pylist() for c in ("a_wide", "a_n", "b_wide", "b_n"))
            kept = [_may_be_similar(*r, percent) for r in zip(x, n, y, m, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "a_n", "a_wide", "b_n", "b_wide").mapInArrow(run, "a long, b long")


def _similar(batches: Iterator[pa.RecordBatch], percent: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (a, b, a_node, b_node, a_text, b_text) whose texts have the sets of that name, and similar ones."""
    for whole in batches:
        size = whole.column("a_text").nbytes + whole.column("b_text").nbytes
        step = max(1, int(whole.num_rows * common.CHUNK * 4 / max(size, 1)))
        for at_row in range(0, whole.num_rows, step):
            batch = whole.slice(at_row, step)
            named, parts, sizes = np.ones(batch.num_rows, bool), [], []
            for side in ("a", "b"):
                names, row = [], 0
                n = np.zeros(batch.num_rows, np.int64)
                for grams, at in shingle_sets(batch.column(f"{side}_text"), shingle):
                    names += _node_names(grams, at)
                    n[row : row + len(at) - 1] = np.diff(at)
                    parts.append((np.repeat(np.arange(row, row + len(at) - 1), np.diff(at)), grams))
                    row += len(at) - 1
                named &= np.array([x == y for x, y in zip(names, batch.column(f"{side}_node").to_pylist(), strict=True)], bool)
                sizes.append(n)
            row, grams = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((grams, row))
            row, grams = row[order], grams[order]
            both = np.bincount(row[1:][(row[1:] == row[:-1]) & (grams[1:] == grams[:-1])], minlength=batch.num_rows)
            kept = named & ((100 + percent) * both >= percent * (sizes[0] + sizes[1]))
            yield batch.select(["a", "b"]).filter(pa.array(kept))
    common.trimmed()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of node ids whose whole sets are similar, as the texts of those nodes' documents give them.

    The texts of `a` travel to those of `b`, which may be in many pairs. docs has no two rows of one key and text.
    """
    pairs = common.staged(plausible(pairs, nodes, percent), "jaccard-plausible")
    side = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df
    of = lambda c: nodes.select(F.col("id").alias(c), F.col("least").alias(f"{c}_key"), F.col("node").alias(f"{c}_node"))
    texts = docs.select(F.col(key).alias("__own"), "text")
    one = texts.join(side(pairs.join(of("a"), "a")), F.col("__own").eqNullSafe(F.col("a_key"))).select("a", "b", "a_node", F.col("text").alias("a_text"))
    two = texts.join(side(pairs.select("b").distinct().join(of("b"), "b")), F.col("__own").eqNullSafe(F.col("b_key"))).select("b", "b_node", F.col("text").alias("b_text"))
    both = one.join(two, "b").select("a", "b", "a_node", "b_node", "a_text", "b_text")
    return both.mapInArrow(lambda batches: _similar(batches, percent, shingle), "a long, b long")


def _mixed_blocks(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """(token, id, comp, n, rows) of the rows (token, id, n) whose token has nodes of more than one group."""
    named = blocks.join(roots, "id", "left").select("id", "n", F.coalesce("root", "id").alias("comp"), "token")
    mixed = common.staged(named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token"), "jaccard-mixed")
    mixed = F.broadcast(mixed) if mixed.count() <= BROADCAST_ROWS else mixed
    named = common.staged(named.join(mixed, "token"), "jaccard-blocks")
    return named.join(named.groupBy("token").agg(F.count("*").alias("rows")), "token")


def _found(blocks: DataFrame, nodes: DataFrame, percent: int, best_only: bool, block_rows: int) -> DataFrame:
    """The pairs (a, b) that blocks bring, each once."""
    blocks = common.staged(blocks, "jaccard-dealt")
    parts = max(blocks.sparkSession.sparkContext.defaultParallelism, math.ceil(blocks.count() / (4 * block_rows)))
    rows = blocks.join(nodes.select("id", "bits"), "id").repartition(parts, "block").select("block", "side", "id", "comp", "n", "bits")
    return rows.mapInArrow(lambda batches: _block_pairs(batches, percent, best_only), "a long, b long").distinct()


def classes(docs: DataFrame, key: str = "doc_id", percent: int = PERCENT, shingle: int = SHINGLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, n_shingles, component) of every row of docs; component is the smallest key that links reach, itself included.

    Texts with equal sets always share a component, but texts without words, null ones included, are linked with nothing.
    Rows without a key link like any other and name no component unless it has no other. Repeated rows stay, other
    columns change nothing, an empty table has no rows.
    """
    rows = common.staged(signed(docs, key, percent, shingle), "jaccard-signed")
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        docs = docs.dropDuplicates([key, "text"])
    nodes = rows.where("node is not null").groupBy("node").agg(F.min(key).alias("least"), *(F.first(c).alias(c) for c in ("n", "heads", "tokens", "bits", "wide")))
    nodes = common.staged(nodes.withColumn("id", F.monotonically_increasing_id()), "jaccard-nodes")

    heads = nodes.select("id", F.posexplode("heads").alias("seed", "head"))
    stars = heads.groupBy("seed", "head").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    stars = stars.select("seed", "head", F.when(F.col("seed") % 2 == 0, F.col("low")).otherwise(F.col("high")).alias("centre"))
    stars = heads.join(stars, ["seed", "head"]).where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    links = common.staged(verified(common.staged(stars.distinct(), "jaccard-stars"), nodes, docs, key, percent, shingle), "jaccard-links")

    blocks, best_only = nodes.select("id", "n", F.explode("tokens").alias("token")), True
    while True:
        roots = components(links).withColumnRenamed("node", "id")
        blocks = _mixed_blocks(blocks, roots)
        pairs = common.staged(_found(dealt(blocks, block_rows), nodes, percent, best_only, block_rows), "jaccard-pairs")
        new = common.staged(verified(pairs, nodes, docs, key, percent, shingle), "jaccard-links")
        links = links.unionByName(new)
        if not best_only:
            break
        best_only = new.count() * ENOUGH > pairs.count()
        blocks = blocks.select("id", "n", "token")

    roots = components(links).withColumnRenamed("node", "id")
    named = nodes.select("id", "node", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = common.staged(named, "jaccard-rooted")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("node", "component")
    return rows.select(key, F.col("n").alias("n_shingles"), "node").join(named, "node", "left").select(key, "n_shingles", F.coalesce("component", key).alias("component"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs."""
    return classes(docs).withColumnRenamed("component", "component_id")
