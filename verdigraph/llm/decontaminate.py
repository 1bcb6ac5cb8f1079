"""Benchmark decontamination by a broadcast hash set of normalised benchmark n-grams.

The n-grams of the benchmark form sorted arrays of 64-bit hashes behind a small bitmap. Training texts are
hashed window by window in numpy, and each hit is verified on the words themselves, so a hash collision
changes nothing. The hash set is broadcast in blocks of a fixed size; a benchmark beyond one block takes one
staged pass over the texts for each block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.llm import common

NGRAM = 13
#: Most bytes of window text in one broadcast block.
BLOCK_BYTES = 16 << 20
#: A document is contaminated if n_hit > 0 and FACTOR * n_hit >= n_words.
FACTOR = 20


def item_windows(benchmark: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """(item_id string, n_words, window binary) of every item: runs of `ngram` words, or the whole of a shorter item.

    Items whose text or item_id is null, or that have no word, give no row.
    """

    def run(batches):
        for batch in batches:
            ids, lengths, windows = [], [], []
            data, at = common.utf8(batch.column("text"))
            data = common.LOWER[data]
            starts, ends, docs = common.spans(data, at, common.ALNUM)
            raw = data.tobytes()
            words = [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            bounds = np.searchsorted(docs, np.arange(batch.num_rows + 1))
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                own = words[bounds[i] : bounds[i + 1]]
                n = min(ngram, len(own))
                for w in {b" ".join(own[k : k + n]) for k in range(len(own) - n + 1)} if own else ():
                    ids.append(item)
                    lengths.append(n)
                    windows.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lengths, pa.int32()), pa.array(windows, pa.binary())], names=["item_id", "n_words", "window"])

    chosen = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    return chosen.mapInArrow(run, "item_id string, n_words int, window binary")


class Index:
    """The windows of one block: sorted hashes by length, and window -> items for verification."""

    def __init__(self, rows: list) -> None:
        self.items: dict[bytes, list[str]] = {}
        by_length: dict[int, set[bytes]] = {}
        for r in rows:
            w = bytes(r["window"])
            self.items.setdefault(w, []).append(r["item_id"])
            by_length.setdefault(r["n_words"], set()).add(w)
        self.hashes, self.bits = {}, {}
        for n, texts in by_length.items():
            h = np.sort(np.array([self.hash(w, n) for w in texts], np.uint64))
            bits = np.zeros(1 << max(16, (8 * len(h)).bit_length()), bool)
            bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            self.hashes[n], self.bits[n] = h, bits

    @staticmethod
    def hash(text: bytes, n: int) -> np.uint64:
        data = np.frombuffer(text, np.uint8)
        s, e, d = common.spans(data, np.array([0, len(data)]), common.ALNUM)
        return common.sequence_hashes(common.word_hashes(data, s, e), d, n)[1][0]

    def candidates(self, n: int, h: np.ndarray) -> np.ndarray:
        bits, known = self.bits[n], self.hashes[n]
        near = np.flatnonzero(bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(known, h[near]), len(known) - 1)
        return near[known[at] == h[near]]


def _marks(text: pa.Array, index: Index) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: words, hit ranges of words, items with occurring windows."""
    out = []
    data, offsets = common.utf8(text)
    for first, last in common.chunks(offsets):
        own = common.LOWER[data[offsets[first] : offsets[last]]]
        at = offsets[first : last + 1] - offsets[first]
        starts, ends, docs = common.spans(own, at, common.ALNUM)
        bounds = np.searchsorted(docs, np.arange(last - first + 1))
        found: dict[int, tuple[list, list, set]] = {}
        if len(starts):
            words = common.word_hashes(own, starts, ends)
            for n in index.hashes:
                at_word, h = common.sequence_hashes(words, docs, n)
                for k in at_word[index.candidates(n, h)].tolist():
                    window = b" ".join(own[s:e].tobytes() for s, e in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist(), strict=True))
                    if window in index.items:
                        d = int(docs[k])
                        s, e, items = found.setdefault(d, ([], [], set()))
                        s.append(k - int(bounds[d]))
                        e.append(k - int(bounds[d]) + n)
                        items.update(index.items[window])
        for d in range(last - first):
            s, e, items = found.get(d, ((), (), set()))
            out.append((int(bounds[d + 1] - bounds[d]), common.ranges(np.array(s, np.int64), np.array(e, np.int64)), items))
    return out


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", _RANGES), T.StructField("items", T.ArrayType(T.StringType()))]
_ARROW_RANGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def marked(docs: DataFrame, benchmark: DataFrame, ngram: int = NGRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_ranges (word ranges inside occurring windows), items (ids as strings, sorted),
    n_hit, n_items and contaminated.

    Null and empty texts have no words and no hits; repeated rows are judged one by one; without benchmark
    rows nothing is hit. Columns of docs named like the added ones are replaced.
    """
    windows = common.staged(item_windows(benchmark, ngram), "benchmark-windows")
    size = windows.agg(F.coalesce(F.sum(F.length("window") + F.length("item_id") + 64), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_bytes))
    spark, out = docs.sparkSession, docs
    for block in range(blocks):
        own = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(Index(own.collect()))
        earlier = block > 0

        def add(batch: pa.RecordBatch, sent=sent, earlier=earlier) -> dict:
            rows = _marks(batch.column("text"), sent.value)
            if earlier:
                old = zip(batch.column("hit_ranges").to_pylist(), batch.column("items").to_pylist(), strict=True)
                rows = [(n, common.ranges(*(np.array([*(x[k] for x in r), *(x[name] for x in a)], np.int64) for k, name in ((0, "start"), (1, "end")))), i | set(b)) for (n, r, i), (a, b) in zip(rows, old, strict=True)]
            return {
                "n_words": pa.array([n for n, _, _ in rows], pa.int64()),
                "hit_ranges": pa.array([[{"start": s, "end": e} for s, e in r] for _, r, _ in rows], _ARROW_RANGES),
                "items": pa.array([sorted(i) for _, _, i in rows], pa.list_(pa.string())),
            }

        out = common.appended(out, add, _FIELDS)
        if block + 1 < blocks:
            out = common.staged(out, "benchmark-pass")
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    out = out.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(FACTOR) * F.col("n_hit") >= F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, action: str = "documents", ngram: int = NGRAM) -> DataFrame:
    """docs without what the benchmark holds, in the columns of docs.

    documents: contaminated documents go. spans: all documents stay and lose the bytes from the first to the
    last word of each hit range. Everything else is as in `marked`.
    """
    if action == "documents":
        return marked(docs.withColumn("__row", F.struct(*docs.columns)).select("text", "__row"), benchmark, ngram).where(~F.col("contaminated")).select("__row.*")
    if action != "spans":
        raise ValueError(f"unknown action: {action}")
    kept = marked(docs.withColumn("__row", F.struct(*docs.columns)).select("text", "__row"), benchmark, ngram)

    def cut(batch: pa.RecordBatch) -> dict:
        texts = []
        for text, hit in zip(batch.column("text").to_pylist(), batch.column("hit_ranges").to_pylist(), strict=True):
            if hit:
                data = np.frombuffer(text.encode(), np.uint8)
                starts, ends, _ = common.spans(common.LOWER[data], np.array([0, len(data)]), common.ALNUM)
                keep = np.ones(len(data), bool)
                for r in hit:
                    keep[starts[r["start"]] : ends[r["end"] - 1]] = False
                text = data[keep].tobytes().decode()
            texts.append(text)
        return {"__text": pa.array(texts, pa.string())}

    done = common.appended(kept.select("text", "hit_ranges", "__row"), cut, [T.StructField("__text", T.StringType())])
    return done.select(*(F.col("__text").alias(c) if c.lower() == "text" else F.col(f"__row.`{c}`") for c in docs.columns))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs."""
    out = marked(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")



#: The contract in DuckDB SQL. Words are found on texts whose A-Z are lower case; a window is 13 joined words.
ORACLE = r"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM doc, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT rid, i, n, item_id FROM grams JOIN win USING (n, g)),
words AS (SELECT rid, count(DISTINCT k) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(k) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hits) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
