"""Quality rules by an isolation forest over rule statistics.

Every document gets counts that hand-made rules would look at. An isolation forest, random splits of random
statistics over small subsamples, measures how few splits set a document apart; the threshold between kept and
dropped is calibrated on all labelled rows that pass the base rules (the labels serve the threshold alone). As the method has
it, a tree sees SUBSAMPLE of these rows; what is dealt to the trees is as many as all of them can see. Statistics and scores
cover every document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigraph.llm import common

TREES = 200
SUBSAMPLE = 256
#: Most labelled rows that the trees' subsamples are drawn from, taken by a hash of doc_id: as many as all trees can see.
FIT_ROWS = TREES * SUBSAMPLE
#: Ranges of scores inside which labelled rows are ranked.
_RANGES = 4096
LEAST_WORDS = 50
MOST_REPEATED = 50
_table = lambda *codes: np.isin(np.arange(256), codes)
_SYMBOL = _table(*b"#*$%&|<>")
_UPPER = _table(*range(0x41, 0x5B))
_LETTER = _table(*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100))
_DIGIT = _table(*range(0x30, 0x3A))
_PUNCTUATION = _table(*b"!?.,;:()[]{}\"'-_/\\=+~^`@")
_SHOUT = _table(*b"!?")
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("upper", "letters", "digits", "punctuation", "shouts", "lines", "distinct", "size")


def _by_doc(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags)]
    return total[at[1:]] - total[at[:-1]]


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text; null is empty. Words are what white space of the contract separates."""
    data, offsets = common.utf8(column)
    parts: dict[str, list[np.ndarray]] = {k: [np.zeros(0, np.int64)] for k in (*_COUNTS, *_MORE)}
    for first, last in common.chunks(offsets):
        own, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        n_docs = last - first
        word = ~common.SPACES
        inside = word[own]
        starts, ends, docs = common.spans(own, at, word)
        out = {"n_words": np.bincount(docs, minlength=n_docs), "word_chars": _by_doc(inside & ((own & 0xC0) != 0x80), at), "size": np.diff(at)}
        for name, table in (("n_symbols", _SYMBOL), ("upper", _UPPER), ("letters", _LETTER), ("digits", _DIGIT), ("punctuation", _PUNCTUATION), ("shouts", _SHOUT)):
            out[name] = _by_doc(table[own], at)
        words = common.word_hashes(own, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        salt = common.mix(np.arange(n_docs).astype(np.uint64) + common.ONE)
        seen, index = np.unique(words ^ salt[docs], return_index=True)
        out["distinct"] = np.bincount(docs[index], minlength=n_docs)
        # words inside 3-word windows that stand twice in their text
        at_word, h = common.sequence_hashes(words, docs, 3)
        _, inverse, times = np.unique(h ^ salt[docs[at_word]], return_inverse=True, return_counts=True)
        twice = at_word[times[inverse] > 1] if len(at_word) else at_word
        cover = np.zeros(len(words) + 4, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 3, -1)
        out["n_repeat_words"] = np.bincount(docs[np.cumsum(cover)[: len(words)] > 0], minlength=n_docs)
        # lines with a word that equal an earlier one
        s, e, d = common.spans(own, at, ~_table(0x0A))
        total = np.r_[0, np.cumsum(inside)]
        full = total[e] > total[s]
        s, e, d = s[full], e[full], d[full]
        lines = (common.word_hashes(own, s, e) if len(s) else np.zeros(0, np.uint64)) ^ salt[d]
        _, index = np.unique(lines, return_index=True)
        out["lines"] = np.bincount(d, minlength=n_docs)
        out["n_dup_lines"] = out["lines"] - np.bincount(d[index], minlength=n_docs)
        for k, v in out.items():
            parts[k].append(v.astype(np.int64))
    return {k: np.concatenate(v) for k, v in parts.items()}


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Rates that don't depend on the length of a text, and the logarithm of that."""
    per = lambda a, b: c[a] / np.maximum(c[b], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]),
            np.minimum(per("word_chars", "n_words"), 30),
            np.minimum(per("n_symbols", "n_words"), 3),
            per("n_repeat_words", "n_words"),
            per("n_dup_lines", "lines"),
            per("upper", "letters"),
            np.minimum(per("digits", "n_words"), 5),
            np.minimum(per("punctuation", "n_words"), 5),
            np.minimum(per("shouts", "n_words"), 3),
            np.log1p(per("n_words", "lines")),
            per("distinct", "n_words") * np.log1p(c["n_words"]),
        ],
        1,
    )


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"])


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


@dataclass
class Forest:
    feature: np.ndarray  # trees x nodes; -1 at leaves
    split: np.ndarray
    child: np.ndarray  # the left child; the right one follows it
    path: np.ndarray  # at leaves: depth, and what the points left there would add
    norm: float
    threshold: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (- mean path length / expected length): near 1 for what few splits isolate."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, path in zip(self.feature, self.split, self.child, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                f = np.maximum(feature[node], 0)
                node = np.where(inner, child[node] + (x[rows, f] >= split[node]), node)
            total += path[node]
        return 2.0 ** (-total / (len(self.feature) * self.norm))


def grown(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    n = min(subsample, len(x))
    limit = max(1, math.ceil(math.log2(max(2, n))))
    size = 2 ** (limit + 1)
    feature, split = np.full((trees, size), -1, np.int64), np.zeros((trees, size))
    child, path = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        todo, free = [(0, rng.choice(len(x), n, replace=False) if n else np.zeros(0, np.int64), 0)], 1
        while todo:
            node, rows, depth = todo.pop()
            own = x[rows]
            wide = np.flatnonzero(own.max(0) > own.min(0)) if len(rows) > 1 else ()
            if depth >= limit or not len(wide):
                path[t, node] = depth + _expected(len(rows))
                continue
            f = int(rng.choice(wide))
            at = rng.uniform(own[:, f].min(), own[:, f].max())
            right = own[:, f] >= at
            if right.all() or not right.any():
                at = np.nextafter(own[:, f].min(), np.inf)
                right = own[:, f] >= at
            feature[t, node], split[t, node], child[t, node] = f, at, free
            todo += [(free, rows[~right], depth + 1), (free + 1, rows[right], depth + 1)]
            free += 2
    return Forest(feature, split, child, path, max(_expected(n), 1e-9))


def calibrated(score: np.ndarray, good: np.ndarray) -> float:
    """The score above which documents are dropped: as few wrong verdicts on the labelled rows as can be; without bad rows, above all scores."""
    if not len(score) or good.all():
        return 1.0
    order = np.argsort(score)
    ranked, y = score[order], good[order]
    wrong = np.r_[y.sum(), y.sum() + np.cumsum(np.where(y, -1, 1))]  # of a cut before each place: good rows above, bad rows below
    at = len(wrong) - 1 - int(np.argmin(wrong[::-1]))
    if at == len(ranked):
        return 1.0
    return float((ranked[at - 1] + ranked[at]) / 2) if at else float(ranked[0]) - 1e-9


def fit(column: pa.Array, good: np.ndarray) -> Forest:
    """Forest and threshold from labelled texts that pass the base rules; the labels set the threshold alone."""
    c = statistics(column)
    passed = ~base_failed(c)
    return fit_features(features(c)[passed], good[passed])


def fit_features(x: np.ndarray, good: np.ndarray) -> Forest:
    """The same from the features of those texts."""
    if len(x) < 2:
        return Forest(np.full((1, 1), -1), np.zeros((1, 1)), np.zeros((1, 1), np.int64), np.ones((1, 1)), 1.0)
    forest = grown(x)
    forest.threshold = calibrated(forest.score(x), good)
    return forest


def _cut(scores: DataFrame) -> float:
    """What `calibrated` finds, over all rows (score, good): good rows lost and bad rows kept are running sums, by ranges of
    scores and then inside them. Rows of equal scores share their verdict."""
    each = scores.groupBy("score").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    each = common.staged(each.withColumn("range", F.floor(F.col("score") * _RANGES)), "quality-scores")
    n = each.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    if not n.bad:
        return 1.0
    gain = F.col("bad") - F.col("good")
    per = each.groupBy("range").agg(F.sum(gain).alias("gain"))  # at most as many rows as there are ranges
    ahead = per.select("range", F.coalesce(F.sum("gain").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("range").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    wrong = F.col("ahead") + F.coalesce(F.sum(gain).over(inside), F.lit(0)) + F.lit(n.good)  # of a cut before this score
    least = each.join(F.broadcast(ahead), "range").select("score", wrong.alias("wrong")).agg(F.min(F.struct("wrong", (-F.col("score")).alias("below")))).first()[0]
    if n.bad <= least.wrong:
        return 1.0
    at = -least.below
    before = each.where(F.col("score") < at).agg(F.max("score")).first()[0]
    return at - 1e-9 if before is None else (before + at) / 2


def fitted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Labels without doc_id or quality are ignored; of repeated labels the smaller counts, of repeated ids one text. The
    executors turn texts into features and rank the scores of all labelled rows; what comes to the driver is at most fit_rows
    rows of some numbers, for the trees."""
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))

    def measured(batches):
        for batch in batches:
            c = statistics(batch.column("text"))
            x = features(c).astype(np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(~base_failed(c)), lists], names=["doc_id", "passed", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {kind}, passed boolean, x array<double>")
    rows = rows.join(known, "doc_id").groupBy("doc_id", "good").agg(F.min(F.struct("passed", "x")).alias("of"))
    rows = common.staged(rows.where("of.passed").select("doc_id", "good", "of.x"), "quality-features")
    found = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows).toArrow().sort_by("doc_id").combine_chunks()
    if found.num_rows < 2:
        return fit_features(np.zeros((0, 1)), np.zeros(0, bool))
    forest = grown(np.array(found.column("x").to_pylist(), np.float64))
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def score(batches):
        for batch in batches:
            x = batch.column("x")
            got = sent.value.score(x.flatten().to_numpy().reshape(len(x), -1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(got), batch.column("good")], names=["score", "good"])

    forest.threshold = _cut(rows.select("good", "x").mapInArrow(score, "score double, good boolean"))
    return forest


def judged(docs: DataFrame, forest: Forest) -> DataFrame:
    """docs with the base counts, base_failed, anomaly (the forest's score) and kept; they replace columns of these names.

    Null and empty texts fail the base rules. Rows are judged one by one, so repeated rows agree.
    """
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def add(batch: pa.RecordBatch) -> dict:
        c = statistics(batch.column("text"))
        score, failed = sent.value.score(features(c)), base_failed(c)
        return {k: pa.array(c[k]) for k in _COUNTS} | {"base_failed": pa.array(failed), "anomaly": pa.array(score), "kept": pa.array(~failed & (score <= sent.value.threshold))}

    fields = [T.StructField(k, T.LongType()) for k in _COUNTS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("anomaly", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return common.appended(docs, add, fields)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs, and the anomaly score."""
    return judged(docs.select("doc_id", "text"), fitted(docs, labels)).select("doc_id", *_COUNTS, "base_failed", "kept", "anomaly")
