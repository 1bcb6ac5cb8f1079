"""Toxicity by averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of itself and of its character n-grams (hashed into buckets), so an unseen
misspelling shares most vectors with the word it hides. A document is the average of its words, common words
damped by their share of the training words; a linear softmax over two classes reads it. Embeddings and softmax
are trained together with Adam on a bounded sample of labelled rows. Scoring runs over all texts: as everything
after the embeddings is linear, each word adds one number, which is computed once for the distinct words of a
batch.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.llm import common

#: Most labelled rows to train on, taken by a hash of doc_id, and most pairs of a text and one of its words: together
#: they bound the memory of the task that trains.
TRAIN_ROWS = 16_384
TRAIN_PAIRS = 1 << 24
#: Pairs or n-grams that one step of the training looks at together.
BLOCK = 1 << 19
BUCKETS = 1 << 16
DIM = 2
NGRAMS = (3, 4)
EPOCHS = 90
RATE = 0.1
DECAY = 1e-4
START = 0.1
#: Texts of the classes' mean that each bucket's odds are smoothed with.
ODDS = 10.0
#: Averages of many words are small; the softmax reads them enlarged.
SCALE = 100.0
#: Common words are damped: weight SMOOTH / (SMOOTH + share of the training words).
SMOOTH = 1e-4
#: Buckets met in fewer training texts keep a zero embedding: they could only be learned by heart.
LEAST_TEXTS = 8
#: An average holds so many words without evidence besides the text's own, so a few words prove little.
PRIOR = 60.0
#: One word counts for so much of a text at most (three times in any text): junk that repeats a word proves nothing.
MOST_PART = 0.005
FOLDS, HELD = 5, 0
_EDGE = np.uint32(1)
_FEATURES = ["pairs", "doc_id", "toxic", "hashes", "counts", "grams"]


def _word_table() -> np.ndarray:
    """Code points that words consist of: letters, digits and marks; all above the basic plane count."""
    table = np.ones(0x10000, bool)
    table[:0xD800] = [chr(c).isalnum() for c in range(0xD800)]
    return table


_WORDY = _word_table()


@dataclass
class Bag:
    """Words of a batch of texts: distinct words, and per text the ids and counts of its words."""

    grams: np.ndarray  # bucket of every n-gram, word by word
    sizes: np.ndarray  # n-grams of each word
    hashes: np.ndarray  # of the distinct words
    word: np.ndarray  # per (text, word), text by text: place in hashes
    lengths: np.ndarray  # distinct words of each text
    count: np.ndarray

    @property
    def texts(self) -> int:
        return len(self.lengths)

    @property
    def word_of_gram(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), self.lengths)


def bag(texts: list[str | None], buckets: int = BUCKETS) -> Bag:
    """Words are lower-case runs of letters and digits; null is empty."""
    lengths = np.array([len(t.lower()) if t else 0 for t in texts], np.int64)
    offsets = np.r_[0, np.cumsum(lengths)]
    codes = np.frombuffer("".join(t.lower() for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    wordy = _WORDY[np.minimum(codes, 0xFFFF)]
    pieces = ([], [], [])
    for first, last in common.chunks(offsets):
        lo, hi = offsets[first], offsets[last]
        own, inside = codes[lo:hi], wordy[lo:hi]
        at = offsets[first : last + 1] - lo
        starts, ends, docs = common.spans(inside.view(np.uint8), at, np.array([False, True]))
        pieces[0].append(common.window(common.prefix(own, common._WORD_BASE), starts, ends, common._WORD_BASE))
        pieces[1].append(docs + first)
        pieces[2].append(np.stack([starts + lo, ends + lo]))
    if not pieces[0]:
        empty = np.zeros(0, np.int64)
        return Bag(empty, empty, empty.astype(np.uint64), empty, np.zeros(len(texts), np.int64), empty)
    h, docs, places = np.concatenate(pieces[0]), np.concatenate(pieces[1]), np.concatenate(pieces[2], axis=1)
    hashes, example, word = np.unique(h, return_index=True, return_inverse=True)
    pair, count = np.unique(docs * len(hashes) + word, return_counts=True)
    # n-grams of the distinct words, each between two edge marks
    starts, sizes = places[0, example], places[1, example] - places[0, example]
    ends = np.cumsum(sizes + 2)
    begins = ends - sizes - 2
    marked = np.full(int(ends[-1]) if len(ends) else 0, _EDGE, np.uint32)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    marked[begins[owner] + 1 + inner] = codes[starts[owner] + inner]
    grams, owners = [hashes % np.uint64(buckets)], [np.arange(len(hashes))]
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    sums = common.prefix(marked, common._WORD_BASE)
    for n in NGRAMS:
        at = np.arange(max(0, len(marked) - n + 1))
        at = at[owner[at] == owner[at + n - 1]]
        grams.append(common.window(sums, at, at + n, common._WORD_BASE) % np.uint64(buckets))
        owners.append(owner[at])
    grams, owners = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    n = max(1, len(hashes))
    return Bag(grams[order], np.bincount(owners, minlength=len(hashes)), hashes, pair % n, np.bincount(pair // n, minlength=len(texts)), count)


class Features:
    """Growing counts of labelled texts: per text its distinct words and their counts, per distinct word one copy of its n-grams."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.kind = np.min_scalar_type(buckets - 1)  # of n-grams, which are most of what is held
        self.words: list[np.ndarray] = []  # of a text, as places in the order in which words came
        self.counts: list[np.ndarray] = []
        self.known = np.zeros(0, np.uint64)  # sorted hashes, and the words' places
        self.place = np.zeros(0, np.int32)
        self.grams: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add_words(self, hashes: np.ndarray, grams: np.ndarray, sizes: np.ndarray) -> None:
        """hashes: sorted and distinct."""
        at = np.searchsorted(self.known, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != hashes[inside]
        self.grams.append(grams[np.repeat(new, sizes)].astype(self.kind))
        self.sizes.append(sizes[new])
        places = np.arange(len(self.known), len(self.known) + int(new.sum()), dtype=np.int32)
        self.known, self.place = np.insert(self.known, at[new], hashes[new]), np.insert(self.place, at[new], places)

    def add_text(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Its words have to be added before."""
        self.words.append(self.place[np.searchsorted(self.known, hashes)])
        self.counts.append(counts)

    def bags(self, *parts: np.ndarray) -> list[Bag]:
        """A bag of each part of the texts; they share the words and their n-grams. What was counted is given up."""
        joined = lambda pieces, kind=np.int32: np.concatenate([np.zeros(0, kind), *pieces]).astype(kind, copy=False)
        hashes = np.empty(len(self.known), np.uint64)
        hashes[self.place] = self.known
        self.known = self.place = None
        grams, self.grams = joined(self.grams, self.kind), []
        sizes = joined(self.sizes)
        lengths = [np.array([len(self.words[k]) for k in texts], np.int32) for texts in parts]
        words, self.words = [joined(self.words[k] for k in texts) for texts in parts], []
        counts, self.counts = [joined(self.counts[k] for k in texts) for texts in parts], []
        return [Bag(grams, sizes, hashes, *own) for own in zip(words, lengths, counts, strict=True)]


def features(texts: list[str | None], buckets: int = BUCKETS) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text (word hashes, counts), and the distinct words' (hashes, n-grams, n-grams per word) of a few texts."""
    b = bag(texts, buckets)
    bounds = np.r_[0, np.cumsum(b.lengths)]
    own = [(b.hashes[b.word[s:e]], b.count[s:e].astype(np.int32)) for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
    return own, (b.hashes, b.grams.astype(np.int32), b.sizes.astype(np.int32))


def counted_texts(texts: list[str | None], buckets: int = BUCKETS, size: int = 512) -> Features:
    """Features of many texts, taken `size` texts at a time."""
    out = Features(buckets)
    for first in range(0, len(texts), size):
        own, words = features(texts[first : first + size], buckets)
        out.add_words(*words)
        for hashes, counts in own:
            out.add_text(hashes, counts)
    return out


def _times(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How often words count in texts of `size` words: as they stand there, up to three times or the part MOST_PART of the text."""
    return np.minimum(count, np.maximum(3, MOST_PART * size))


@dataclass
class Model:
    """What scoring needs: per bucket the embedding's part of the class difference, and the words' damping."""

    part: np.ndarray
    bias: float
    common_words: np.ndarray  # sorted hashes of the damped words
    damping: np.ndarray

    def weights(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes))
        if len(self.common_words):
            at = np.minimum(np.searchsorted(self.common_words, hashes), len(self.common_words) - 1)
            out = np.where(self.common_words[at] == hashes, self.damping[at], 1.0)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.score_bag(bag(texts, len(self.part)))

    def score_bag(self, b: Bag) -> np.ndarray:
        per_word = _by_owner(b.sizes, lambda s, e: self.part[b.grams[s:e]]) / np.maximum(1, b.sizes)
        w, text = self.weights(b.hashes), b.text
        times = _times(b.count, np.bincount(text, b.count, b.texts)[text])
        mass = np.bincount(text, w[b.word] * times, b.texts)
        total = np.bincount(text, (w * per_word)[b.word] * times, b.texts)
        logit = total / (mass + PRIOR) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _blocks(sizes: np.ndarray):
    """(first owner, end, first item, end) of blocks of about BLOCK items, where each owner has `sizes` items in a row."""
    offsets = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    for first, last in common.chunks(offsets, BLOCK):
        yield first, last, int(offsets[first]), int(offsets[last])


def _by_owner(sizes: np.ndarray, value) -> np.ndarray:
    """Each owner's sum of value(start, end) of its items, block by block."""
    out = np.zeros(len(sizes))
    for first, last, s, e in _blocks(sizes):
        out[first:last] = np.bincount(np.repeat(np.arange(last - first), sizes[first:last]), value(s, e), last - first)
    return out


def _by_key(keys: np.ndarray, sizes: np.ndarray, n: int, of_owner: np.ndarray, factor: np.ndarray | None = None) -> np.ndarray:
    """Sums, by key, of what the items' owners have, times the items' factor; block by block."""
    out = np.zeros(n)
    for first, last, s, e in _blocks(sizes):
        value = np.repeat(of_owner[first:last], sizes[first:last])
        out += np.bincount(keys[s:e], value if factor is None else value * factor[s:e], n)
    return out


def train(texts: list[str | None], labels: list[int], **options) -> Model:
    """A model from texts and their labels; see `learned`."""
    return learned(counted_texts(texts, options.get("buckets", BUCKETS)), np.array(labels, np.float64), **options)


def learned(counted: Features, y: np.ndarray, **options) -> Model:
    """Embeddings and softmax from four fifths of the texts; the last fifth sets the scale and bias of the logits,
    as logits are too sure on the texts that the embeddings have seen."""
    held = np.arange(len(y)) % 5 == 4
    most, rest = counted.bags(np.flatnonzero(~held), np.flatnonzero(held))
    common.trimmed()
    model, y = _train(most, y[~held], **options), y[held]
    if len(set(y.tolist())) < 2 or not model.part.any():
        return model
    score = np.clip(model.score_bag(rest), 1e-12, 1 - 1e-12)
    logit = np.log(score / (1 - score))
    x = np.stack([logit, np.ones(len(y))], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(50):  # Newton's method with a weak pull towards the uncorrected logits
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        theta = theta - np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * (theta - (1.0, 0.0)))
    if theta[0] > 0 and np.isfinite(theta).all():
        model.part, model.bias = model.part * theta[0], model.bias * theta[0] + theta[1]
    return model


def _train(b: Bag, y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, dim: int = DIM, buckets: int = BUCKETS, seed: int = 7) -> Model:
    """Without rows of both classes the model gives everyone the share of class 1 (0 without rows).

    Pairs and n-grams are kept as small numbers and passed over in blocks, so what a step adds to them is bounded; whose
    they are is told by how many each text or word has.
    """
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(buckets), 30.0 * (2 * float(y.mean()) - 1) if len(y) else -30.0, np.zeros(0, np.uint64), np.zeros(0))
    n_words = len(b.hashes)
    once = np.ones(b.texts)
    share = _by_key(b.word, b.lengths, n_words, once, b.count) / max(1, b.count.sum())
    damp = SMOOTH / (SMOOTH + share)
    kept = damp < 0.999
    place = np.flatnonzero(kept)[np.argsort(b.hashes[kept])]
    model = Model(np.zeros(buckets), 0.0, b.hashes[place], damp[place])
    size = _by_owner(b.lengths, lambda s, e: b.count[s:e])
    a = np.empty(len(b.word), np.float32)
    for first, last, s, e in _blocks(b.lengths):
        own = b.lengths[first:last]
        weight = damp[b.word[s:e]] * _times(b.count[s:e], np.repeat(size[first:last], own))
        mass = np.bincount(np.repeat(np.arange(last - first), own), weight, last - first) + PRIOR
        a[s:e] = weight / np.repeat(mass, own)
    per_gram = 1 / np.maximum(1, b.sizes)
    # texts that a bucket is met in, all and those of class 1
    met, met_1 = (_by_key(b.grams, b.sizes, buckets, _by_key(b.word, b.lengths, n_words, x)) for x in (once, y))
    used = np.flatnonzero(met >= LEAST_TEXTS)
    rng = np.random.default_rng(seed)
    # the first embedding dimension starts at the bucket's log odds, smoothed towards the classes' shares; the rest near 0
    ones, zeros, share_1 = met_1[used], met[used] - met_1[used], y.mean()
    odds = np.log((ones + ODDS * share_1) / (zeros + ODDS * (1 - share_1)) * (1 - share_1) / share_1)
    e = rng.standard_normal((dim, len(used))) * START
    e[0] += START * odds
    w = rng.standard_normal((dim, 2)) * START
    w[0] += (-1.0, 1.0)
    bias = np.log(np.array([1 - share_1, share_1]))
    onehot = np.stack([1 - y, y], 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, bias)]
    part = np.zeros(buckets)  # of the buckets in use; the others stay zero
    for step in range(1, epochs + 1):
        docs = np.empty((dim, b.texts))
        for x, doc in zip(e, docs, strict=True):
            part[used] = x
            of_word = _by_owner(b.sizes, lambda s, t: part[b.grams[s:t]]) * per_gram
            doc[:] = _by_owner(b.lengths, lambda s, t, x=of_word: x[b.word[s:t]] * a[s:t]) * SCALE
        z = docs.T @ w + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        dz = (p - onehot) / len(y)
        d_words = (_by_key(b.word, b.lengths, n_words, x, a) * per_gram for x in w @ dz.T * SCALE)
        d_e = np.stack([_by_key(b.grams, b.sizes, buckets, x)[used] for x in d_words])
        for param, grad, (m, v) in zip((e, w, bias), (d_e + DECAY * e, docs @ dz, dz.sum(0)), moments, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model.part[used] = (w[:, 1] - w[:, 0]) @ e * SCALE
    model.bias = float(bias[1] - bias[0])
    return model


def fold(folds: int = FOLDS):
    return F.crc32(F.col("doc_id").cast("string")) % folds


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, train_pairs: int = TRAIN_PAIRS) -> Model:
    """Trains on at most train_rows labelled rows outside the held fold, chosen by a hash of doc_id, with at most
    train_pairs pairs of text and word. The executors count words and n-grams; the training task never sees a text.

    Labels without doc_id or toxic are ignored; of repeated labels the larger counts.
    """
    chosen = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(fold() != HELD)
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = common.staged(chosen, "toxicity-labels")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("text").alias("text"))

    def counted(batches):
        """A row per text (its words and counts) and per slice of texts (its distinct words, their n-grams)."""
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                part = whole.slice(at, 1024)
                own, (hashes, grams, sizes) = features(part.column("text").to_pylist())
                ends = np.cumsum([0, *(len(w) for w, _ in own)])
                words = np.concatenate([np.zeros(0, np.uint64), *(w for w, _ in own)]).view(np.int64)
                counts = np.concatenate([np.zeros(0, np.int32), *(c for _, c in own)])
                none = pa.nulls(1, pa.int64())
                lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(ends[1:] - ends[:-1]), part.column("doc_id").cast(pa.string()), part.column("toxic").cast(pa.int64()), lists(words, ends), lists(counts, ends), pa.nulls(part.num_rows, pa.list_(pa.int32()))], names=_FEATURES)
                yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.string()), none, lists(hashes.view(np.int64), [0, len(hashes)]), lists(sizes, [0, len(sizes)]), lists(grams, [0, len(grams)])], names=_FEATURES)

    # words come before texts, and texts in the hashes' order: they count while all their pairs are within train_pairs.
    # Nothing is staged: the sort is of at most train_rows rows, and many small files cost executors more than a shuffle
    made = rows.mapInArrow(counted, "pairs long, doc_id string, toxic long, hashes array<long>, counts array<int>, grams array<int>")
    made = made.repartition(1).sortWithinPartitions(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"), "doc_id")

    def gather(batches) -> tuple[Features, np.ndarray]:
        got, labels, pairs = Features(), [], 0
        for batch in batches:
            sizes, ids, labels_of, hashes, counts, grams = (batch.column(c) for c in _FEATURES)
            for i in range(batch.num_rows):
                values = [np.array(x[i].values) for x in (hashes, counts)]
                if not ids[i].is_valid:
                    got.add_words(values[0].view(np.uint64), grams[i].values.to_numpy(), values[1])
                elif (pairs := pairs + sizes[i].as_py()) <= train_pairs:
                    labels.append((ids[i].as_py(), labels_of[i].as_py(), len(got.words)))
                    got.add_text(values[0].view(np.uint64), values[1])
        labels.sort()
        order = [k for _, _, k in labels]
        got.words, got.counts = [got.words[k] for k in order], [got.counts[k] for k in order]
        return got, np.array([x > 0 for _, x, _ in labels], np.float64)

    def learn(batches):
        model = learned(*gather(batches))
        common.trimmed()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # one task trains on counted features: rows and pairs are bounded, and if its executor is lost another one repeats it
    found = made.mapInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], [])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5, else 0); they replace columns of these names.

    Null and empty texts get the score of a text without evidence.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def add(batch: pa.RecordBatch) -> dict:
        score = np.concatenate([sent.value.score(batch.column("text").slice(at, 512).to_pylist()) for at in range(0, batch.num_rows, 512)])
        return {"score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))}

    return common.appended(docs, add, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the model does not call toxic, in the columns of docs; rows may have any doc_id or none."""
    sent, at_text = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels)), docs.columns.index("text")

    def keep(batches):
        """Rows go in and out 512 at a time, each text once."""
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield part.filter(pa.array(sent.value.score(part.column(at_text).to_pylist()) < 0.5))
        common.trimmed()

    return docs.mapInArrow(keep, docs.schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for every row of docs; a null doc_id is not held out."""
    out = scored(docs.select("doc_id", "text"), fitted(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == HELD, F.lit(False)).alias("held_out"), "score", "predicted")
