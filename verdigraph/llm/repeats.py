"""Removal of long repeats by a common-prefix-aware distributed merge sort of suffixes.

Every byte that a repeated string of `length` bytes covers goes. Suffixes are sorted at anchors only: the
least-hash seeds of sliding windows, of which each such string holds at least one, at a place that depends on
nothing but the string. Anchors whose seed stands nowhere else are left out by a bitmap that is sized by the number
of repeated seeds, up to a bound; a wrong bit only costs work. The steps:

* Each map task sorts its anchors' suffixes (seed hash, bytes to the right as far as the anchor's strings reach,
  then the bytes to the left, reversed), cuts the sorted run at the ranges' borders and front-codes the pieces:
  a suffix is sent as the length it shares with its predecessor and the rest.
* A range's runs are merged by a loser tree that keeps, for every suffix in it, the length shared with the last
  winner. Different lengths decide a match without a look at the bytes; equal ones resume after the known prefix.
* In the merged order equal suffixes repeat in whole. A suffix is compared with the NEAR distinct ones in front of
  it: the bytes that two share to the right and to the left of their anchors are a repeat. Where more than NEAR
  suffixes share enough, the strings that only a farther one can repeat, and that none of the near ones already
  stands for, are sent on and counted by 128-bit hashes.
* A seed that very many anchors share would make one range larger than all others. The strings of its anchors are
  counted by their 128-bit hashes at once, with map-side combining, so no task holds such a group.

Texts are told apart by their digest, so copies of a text share their result and no row numbers are needed.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm import common

LENGTH = 400
SEED = 64
#: Bits of the seeds' bitmap per repeated seed, and the most bits it may have.
SEED_BITS, FILTER_BITS = 16, 1 << 28
#: A seed with more anchors is hot; as many seeds as this can be hot at most, beyond that the first number grows.
HOT, MOST_HOT = 50_000, 1_000_000
RANGE_BYTES = 8 << 20
RUN_BYTES = 32 << 20
#: Distinct suffixes in front that a suffix is compared with directly.
NEAR = 16
_BASE = 0x9E3779B97F4A7C15
#: A text with an anchor in fewer bytes than this repeats itself; its own repeats are found before the exchange.
_DENSE = 40
_PAYLOAD = np.dtype([("text", "S16"), ("at", "<i8"), ("right", "<i4"), ("size", "<i4"), ("lcp", "<i4")])
_MARK = np.dtype([("text", "S16"), ("start", "<i8"), ("end", "<i8")])


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` successive values."""
    n = len(v)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = v
    rows = padded.reshape(blocks, width)
    front = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], front[width - 1 : n])


def _earlier(data: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Where each string of `length` bytes stood last before, or -1. Equal hashes only propose: the bytes decide."""
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    before = np.full(len(hashes), -1, np.int64)
    before[order[same + 1]] = order[same]
    at = np.flatnonzero(before >= 0)
    if not len(at):
        return before
    cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(before[at]) != 1)])
    for s, e in zip(at[cut].tolist(), at[np.r_[cut[1:], len(at)] - 1].tolist(), strict=True):  # successive strings that stood before in succession
        was = int(before[s])
        if not np.array_equal(data[s : e + length], data[was : was + e - s + length]):
            raw, last = data.tobytes(), {}  # unequal strings with one hash: built on purpose
            for i in range(len(hashes)):
                key = xxhash.xxh3_128_digest(raw[i : i + length])
                before[i] = last.get(key, -1)
                last[key] = i
            break
    return before


class Anchors:
    """Anchors of a run of documents: seed hash, place, and the starts (low to high, inclusive) of the strings they stand for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, seed: int) -> None:
        n = len(data)
        self.seeds = self.place = self.low = self.high = self.doc = np.zeros(0, np.int64)
        if n < length:
            return
        self.data = data
        self.sums = common.prefix(data, _BASE)
        first = np.arange(n - seed + 1)
        h = common.window(self.sums, first, first + seed, _BASE)
        bits = np.uint64(32)  # whatever the run's size: the choice between seeds must depend on the string alone
        least = _sliding_least((h >> bits << bits) | first.astype(np.uint64), length - seed + 1)
        anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        sizes = np.maximum(np.diff(offsets) - length + 1, 0)
        starts = np.repeat(offsets[:-1], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        docs = np.repeat(np.arange(len(sizes)), sizes)
        own = anchor[starts]
        if not len(own):
            return
        cut = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (docs[1:] != docs[:-1])])
        last = np.r_[cut[1:], len(own)] - 1
        self.place, self.low, self.high, self.doc = own[cut], starts[cut], starts[last], docs[cut]
        self.seeds = common.mix(~h[self.place])  # least hashes are all small; the ranges want them spread evenly

    def settle(self, offsets: np.ndarray, length: int) -> list[tuple[int, int, int]]:
        """(document, start, end) of what texts with many anchors repeat of themselves. Anchors that stand only for
        strings met before in the same text go."""
        if not len(self.place):
            return []
        count = np.bincount(self.doc, minlength=len(offsets) - 1)
        keep, marks = np.ones(len(self.place), bool), []
        for d in np.flatnonzero(count * _DENSE > np.diff(offsets)).tolist():
            n = int(offsets[d + 1] - offsets[d]) - length + 1
            before = _earlier(self.data[offsets[d] : offsets[d + 1]], common.window(self.sums, np.arange(n) + offsets[d], np.arange(n) + offsets[d] + length, _BASE), length)
            twice = before >= 0
            first = np.flatnonzero(~twice)
            twice[before[twice]] = True
            repeated = np.flatnonzero(twice)
            marks += [(d, int(a), int(b)) for a, b in common.ranges(repeated, repeated + length)]
            new = np.zeros(n + 1, np.int64)
            new[first + 1] = 1
            new = np.cumsum(new)
            own = np.flatnonzero(self.doc == d)
            keep[own] = new[self.high[own] - offsets[d] + 1] > new[self.low[own] - offsets[d]]
        for name in ("place", "low", "high", "doc", "seeds"):
            setattr(self, name, getattr(self, name)[keep])
        return marks


def _shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which `known` bytes are known to agree."""
    low, high = known, min(len(a), len(b))
    step = 16
    while low < high:  # gallop, then halve
        to = min(low + step, high)
        if a[low:to] == b[low:to]:
            low, step = to, 2 * step
            continue
        while to - low > 1:
            mid = (low + to) // 2
            if a[low:mid] == b[low:mid]:
                low = mid
            else:
                to = mid
        return low
    return low


def front_coded(keys: list[bytes]) -> tuple[list[int], bytes]:
    """Shared lengths with the predecessor, and the rests."""
    lcps, rests, before = [], [], b""
    for key in keys:
        n = _shared(before, key, 0)
        lcps.append(n)
        rests.append(key[n:])
        before = key
    return lcps, b"".join(rests)


class LoserTree:
    """Merges sorted runs of (key, shared length with the run's predecessor) into one, with shared lengths.

    Each inner node keeps the loser of its match. All entries know the length that they share with the last winner.
    """

    def __init__(self, runs: list) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.now = [self._next(i) for i in range(self.k)]
        self.tree = [0] * self.k
        winners = [0] * self.k + list(range(self.k))
        for node in range(self.k - 1, 0, -1):
            winners[node], self.tree[node] = self._match(winners[2 * node], winners[2 * node + 1])
        self.top = winners[1]

    def _next(self, i: int):
        """[key, shared length with the last winner, payload], or None after the last."""
        return next(self.runs[i], None) if i < len(self.runs) else None

    def _match(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length becomes the one with the winner, which wins next."""
        a, b = self.now[i], self.now[j]
        if b is None:
            return i, j
        if a is None:
            return j, i
        if a[1] > b[1]:
            return i, j
        if a[1] < b[1]:
            return j, i
        n = _shared(a[0], b[0], a[1])
        if a[0][n:] <= b[0][n:]:
            b[1] = n
            return i, j
        a[1] = n
        return j, i

    def __iter__(self):
        while (entry := self.now[self.top]) is not None:
            yield entry
            i = self.top
            self.now[i] = self._next(i)
            node = (i + self.k) // 2
            while node:
                i, self.tree[node] = self._match(i, self.tree[node])
                node //= 2
            self.top = i


def _run(payload: np.ndarray, rest: bytes):
    """The entries of a front-coded run."""
    before, at = b"", 0
    texts, places, right = payload["text"], payload["at"].tolist(), payload["right"].tolist()
    raw = texts.tobytes()
    for i, (size, lcp) in enumerate(zip(payload["size"].tolist(), payload["lcp"].tolist(), strict=True)):
        before = before[:lcp] + rest[at : at + size - lcp]
        at += size - lcp
        yield [before, lcp, (raw[16 * i : 16 * i + 16], places[i], right[i])]


def _exchanged(bits: np.ndarray | None, hot: np.ndarray, n_ranges: int, length: int, seed: int):
    """Map side: front-coded sorted runs of the anchors whose seeds pass the bitmap and are not hot, cut at the ranges' borders.
    What texts repeat of themselves goes along with negative range numbers."""

    def cut_run(keys: list[bytes], rows: list[tuple], out: list[list]) -> None:
        order = sorted(range(len(keys)), key=keys.__getitem__)
        ranges = np.array([int.from_bytes(keys[i][:8], "big") * n_ranges >> 64 for i in order], np.int64)
        edges = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1], True]).tolist() if len(order) else []
        for cut, end in zip(edges[:-1], edges[1:], strict=True):
            own = [keys[i] for i in order[cut:end]]
            payload = np.zeros(len(own), _PAYLOAD)
            for name, values in zip(("text", "at", "right"), zip(*(rows[i] for i in order[cut:end]), strict=True), strict=True):
                payload[name] = values
            lcps, rest = front_coded(own)
            payload["size"], payload["lcp"] = [len(k) for k in own], lcps
            for column, value in zip(out, (int(ranges[cut]), payload.tobytes(), rest), strict=True):
                column.append(value)
        keys.clear()
        rows.clear()

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            keys, rows, marks, held = [], [], [], 0
            out: list[list] = [[], [], []]
            for first, last in common.chunks(offsets):
                own, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                anchors = Anchors(own, at, length, seed)
                raw = own.tobytes()
                digests: dict[int, bytes] = {}

                def digest(d, raw=raw, at=at, digests=digests):
                    if d not in digests:
                        digests[d] = hashlib.md5(raw[at[d] : at[d + 1]]).digest()
                    return digests[d]

                marks += [(digest(d), s, e) for d, s, e in anchors.settle(at, length)]
                for i in np.flatnonzero(_passes(bits, anchors.seeds) & ~np.isin(anchors.seeds, hot)).tolist() if len(anchors.place) else ():
                    d, a, low, high = int(anchors.doc[i]), int(anchors.place[i]), int(anchors.low[i]), int(anchors.high[i])
                    keys.append(int(anchors.seeds[i]).to_bytes(8, "big") + raw[a : high + length] + raw[low:a][::-1])
                    rows.append((digest(d), a - int(at[d]), high + length - a))
                    held += len(keys[-1])
                if held > RUN_BYTES:
                    cut_run(keys, rows, out)
                    held = 0
            cut_run(keys, rows, out)
            if marks:
                for column, value in zip(out, (-1 - xxhash.xxh32_intdigest(marks[0][0]) % n_ranges, np.array(marks, _MARK).tobytes(), b""), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["range", "payload", "rest"])

    return run


def _passes(bits: np.ndarray | None, seeds: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(seeds), bool)
    place = (seeds & np.uint64(64 * len(bits) - 1)).astype(np.int64)
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1


def _hot_strings(hot: np.ndarray, length: int, seed: int):
    """(text, start, h1, h2) of every string that an anchor with a hot seed stands for."""

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            for first, last in common.chunks(offsets):
                own, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                anchors = Anchors(own, at, length, seed)
                anchors.settle(at, length)
                texts, starts, digests = [], [], []
                raw = own.tobytes() if len(anchors.place) else b""
                for i in np.flatnonzero(np.isin(anchors.seeds, hot)).tolist() if raw else ():
                    d = int(anchors.doc[i])
                    text = hashlib.md5(raw[at[d] : at[d + 1]]).digest()
                    for s in range(int(anchors.low[i]), int(anchors.high[i]) + 1):
                        texts.append(text)
                        starts.append(s - int(at[d]))
                        digests.append(xxhash.xxh3_128_digest(raw[s : s + length]))
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(starts, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["text", "start", "h1", "h2"])

    return run


_FOUND = "text binary, start long, end long, h1 long, h2 long"


def _settled(cluster: list, length: int, near: int, put) -> None:
    """cluster: merged groups [key, shared length with the group before, members] that share a seed, in order.

    Strings are named by j, the bytes that they have in front of the anchor.
    """
    n = len(cluster)
    sides = []
    for key, _, members in cluster:
        right = members[0][2]
        sides.append((right, key[8 + right :]))
        if len(members) > 1:
            for text, at, _ in members:
                put(text, at - len(sides[-1][1]), at + right)
    if n == 1:
        return
    shared = [g[1] - 8 for g in cluster]  # to the right, with the group before (or more, where texts end)
    found: list[list[tuple[int, int]]] = [[] for _ in cluster]
    stands: list[list[tuple[int, int]]] = [[] for _ in cluster]
    for i in range(1, n):
        right, left = sides[i]
        r = length
        for x in range(i - 1, max(-1, i - 1 - near), -1):
            r = min(r, shared[x + 1])
            both = min(r, right, sides[x][0])
            if r + len(left) < length:
                break  # suffixes farther in front share even less
            other = sides[x][1]
            if both + min(len(left), len(other)) >= length:
                common_left = _shared(left, other, 0)
                if both + common_left >= length:
                    found[i].append((length - both, common_left))
                    found[x].append((length - both, common_left))
                    stands[i].append((length - both, common_left))
    for i, (key, _, members) in enumerate(cluster):
        right, left = sides[i]
        if len(members) == 1 and found[i]:
            text, at, _ = members[0]
            for low, high in common.ranges(*np.array(found[i]).T):
                put(text, at - high, at + length - low)
        if n <= near + 1:
            continue
        far = 0
        if i > near:
            far = min(shared[i - near : i + 1])
        if i + near + 1 < n:
            far = max(far, min(shared[i + 1 : i + near + 2]))
        low = max(length - right, length - far)
        if low <= len(left):
            whole = left[::-1] + key[8 : 8 + right]
            covered = set()
            for a, b in stands[i]:
                covered.update(range(a, b + 1))
            for text, at, _ in members[:1]:
                for j in range(low, len(left) + 1):
                    if j not in covered:
                        start = len(left) - j
                        put(text, at - j, None, xxhash.xxh3_128_digest(whole[start : start + length]))


def _merged(length: int, near: int):
    """Reduce side: rows of what repeats (start, end), and of strings to be counted (start, h1, h2)."""

    def run(batches):
        runs: dict[int, list] = {}
        out: list[list] = [[], [], [], []]

        def put(text, start, end, h=None):
            for column, value in zip(out, (text, start, end, h), strict=True):
                column.append(value)

        def flush():
            h = np.frombuffer(b"".join(x or bytes(16) for x in out[3]), "<i8").reshape(-1, 2)
            none = np.array([x is None for x in out[3]], bool)
            made = [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(h[:, 0], pa.int64(), mask=none), pa.array(h[:, 1], pa.int64(), mask=none)]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(made, names=["text", "start", "end", "h1", "h2"])

        for batch in batches:
            for r, payload, rest in zip(*(batch.column(c).to_pylist() for c in ("range", "payload", "rest")), strict=True):
                if r < 0:
                    for text, start, end in np.frombuffer(payload, _MARK).tolist():
                        put(text.ljust(16, b"\0"), start, end)
                else:
                    runs.setdefault(r, []).append((payload, rest))
        for r in sorted(runs):
            cluster: list = []
            for key, shared, member in LoserTree([_run(np.frombuffer(p, _PAYLOAD), rest) for p, rest in runs.pop(r)]):
                last = cluster[-1] if cluster else None
                if last and shared == len(key) == len(last[0]) and member[2] == last[2][0][2]:
                    last[2].append(member)
                    continue
                if last and shared < 8:
                    _settled(cluster, length, near, put)
                    cluster = []
                    if len(out[0]) > 50_000:
                        yield flush()
                cluster.append((key, shared, [member]))
            _settled(cluster, length, near, put) if cluster else None
        yield flush()

    return run


def marked(docs: DataFrame, length: int = LENGTH, near: int = NEAR, hot: int = HOT) -> DataFrame:
    """(digest, ranges): per text that holds repeats, by the md5 of its bytes, the byte ranges of repeated strings.

    Null and short texts hold none. Ranges may overlap; their number is bounded by the text's own length.
    """
    spark, seed = docs.sparkSession, min(SEED, length)
    texts = docs.select("text").where(F.octet_length("text") >= length)

    def seeds(batches):
        for batch in batches:
            data, offsets = common.utf8(batch.column("text"))
            found = [np.zeros(0, np.uint64)]
            for first, last in common.chunks(offsets):
                at = offsets[first : last + 1] - offsets[first]
                anchors = Anchors(data[offsets[first] : offsets[last]], at, length, seed)
                anchors.settle(at, length)
                found.append(anchors.seeds.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["seed"])

    counts = texts.mapInArrow(seeds, "seed long").groupBy("seed").count().where("count > 1")
    counts = common.staged(counts, "repeated-seeds")
    total, n_seeds = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    size = max(1 << 16, min(FILTER_BITS, 1 << (SEED_BITS * n_seeds).bit_length()))
    place = F.col("seed").bitwiseAND(F.lit(size - 1))
    words = counts.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(seed & 63 as int))")).alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    bits = np.zeros(size >> 6, np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    many = counts.where(F.col("count") > max(hot, total // MOST_HOT)).select("seed").toArrow().column("seed").to_numpy().view(np.uint64)  # MOST_HOT rows at most
    sent = spark.sparkContext.broadcast((bits, many))
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total * 1.5 * length / RANGE_BYTES))
    runs = texts.mapInArrow(lambda batches: _exchanged(*sent.value, n_ranges, length, seed)(batches), "range int, payload binary, rest binary")
    found = common.staged(runs.repartition(n_ranges, "range").mapInArrow(_merged(length, near), _FOUND), "repeat-candidates")

    strings = found.where("h1 is not null").select("text", "start", "h1", "h2")
    if len(many):  # copies of a text send the same rows, which combine before they are counted
        strings = strings.unionByName(texts.mapInArrow(lambda batches: _hot_strings(sent.value[1], length, seed)(batches), "text binary, start long, h1 long, h2 long"))
        strings = common.staged(strings.groupBy("text", "start", "h1", "h2").agg(F.count("*").alias("n")), "repeat-strings")
    else:
        strings = strings.withColumn("n", F.lit(1).cast("long"))
    twice = strings.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2")
    repeated = strings.hint("merge").join(twice, ["h1", "h2"]).select("text", "start", (F.col("start") + length).alias("end"))
    whole = found.where("h1 is null").select("text", "start", "end")
    return repeated.unionByName(whole).groupBy(F.lower(F.hex("text")).alias("digest")).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def cleaned(docs: DataFrame, length: int = LENGTH, near: int = NEAR, hot: int = HOT) -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans) of every row of docs.

    Null texts are empty; repeated rows are documents of their own, so their texts repeat each other; kept are the
    remaining bytes, which need not be whole characters where a repeat begins or ends inside one.
    """
    rows = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    found = common.staged(marked(docs, length, near, hot), "repeat-ranges")  # a join of two exchanges, so that copies of one text can be split
    joined = rows.hint("merge").join(found, "digest", "left").select("doc_id", "text", "ranges")

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list] = [[], [], [], []]
                data, offsets = common.utf8(batch.column("text"))
                found = batch.column("ranges")
                lists = found.offsets.to_numpy()
                values = found.values
                starts, ends = values.field("start").to_numpy(), values.field("end").to_numpy()
                for i in range(batch.num_rows):
                    own, kept, n_spans = data[offsets[i] : offsets[i + 1]], None, 0
                    if lists[i] < lists[i + 1]:
                        spans = common.ranges(starts[lists[i] : lists[i + 1]], ends[lists[i] : lists[i + 1]])
                        keep = np.ones(len(own), bool)
                        for s, e in spans:
                            keep[s:e] = False
                        n_spans, kept = len(spans), own[keep].tobytes()
                    kept = own.tobytes() if kept is None else kept
                    for column, value in zip(out, (kept, len(own), len(own) - len(kept), n_spans), strict=True):
                        column.append(value)
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs, and `text`, what remains of it. Where a repeat begins or ends
    inside a character, the rest of that character reads as U+FFFD in `text`; kept_sha256 is of the bytes themselves."""
    out = cleaned(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.expr("make_valid_utf8(cast(kept as string))").alias("text"))
