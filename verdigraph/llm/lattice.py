"""Language-model scores by subword lattices: the probability of a text summed over all its segmentations.

The vocabulary is that of an existing tokenizer. No unigram model is at hand whose scores are log probabilities: this
one's scores are ranks, and 1 / (rank + c) is the prior of a unigram distribution over pieces and the end of a text,
which expected piece counts over all training words update (one step of expectation and maximisation after a start
from the tokenizer's own segmentations). No piece crosses a word, so a text's probability is the product of its
words' and of the end's, and a word's is the sum over the paths of its lattice: a forward recursion in log space, run
once for every distinct word, over many words of one length at a time. A character without a piece, like any other,
can also be spelled by its byte pieces.

A second column, mixed_score, gives each training word one more arc of its own lattice, from end to end, whose weight
is its discounted count; what the discount takes from all words is the weight of the way through the pieces.

Counts and word probabilities meet the texts in two ways: the most frequent words, a table of bounded size, are
broadcast; all other words of a text are joined by the word. The result is the same for any split of the two.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigraph.llm import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FOLDS, HELD = 7, 2
#: Words that are broadcast with their numbers.
FREQUENT = 200_000
#: Weight of the vocabulary's own scores, in pieces, and the c of 1 / (rank + c).
PRIOR_PIECES = 10_000.0
RANK_SHIFT = 10.0
#: What each training word's count gives to the ways through the pieces.
DISCOUNT = 0.7
_SLICE, _FLUSH = 512, 300_000
#: Characters whose lattices are held at a time, and the length from which a word is passed over in blocks.
_CHARS, _LONG = 1 << 16, 256
_BASE = 0x9E3779B97F4A7C15
_MARK = "▁"


class Vocabulary:
    """Pieces, their prior probabilities and the ids of the byte pieces; the last id is the end of a text."""

    def __init__(self, model: bytes) -> None:
        self.model = model
        self.processor = p = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = p.get_piece_size()
        self.pieces = [p.id_to_piece(i) for i in range(self.size)]
        plain = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in range(self.size)]
        self.plain = [i for i in range(self.size) if plain[i]]
        self.bytes = [0] * 256
        for i in range(self.size):
            if p.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        rank = np.full(self.size + 1, float(self.size))
        rank[self.plain] = [-p.get_score(i) for i in self.plain]
        usable = np.array([*(plain[i] or p.is_byte(i) for i in range(self.size)), True])
        self.prior = np.where(usable, 1 / (np.maximum(rank, 0) + RANK_SHIFT), 0)
        self.prior /= self.prior.sum()

    def log_probabilities(self, counts: np.ndarray) -> np.ndarray:
        p = counts * (self.prior > 0) + PRIOR_PIECES * self.prior
        with np.errstate(divide="ignore"):
            return np.log(p / p.sum())


class Lattice:
    """Marginal log probabilities (natural) of words under piece log probabilities, and expected piece counts."""

    def __init__(self, vocabulary: Vocabulary, log_p: np.ndarray) -> None:
        self.size, self.log_p = vocabulary.size, np.asarray(log_p, np.float64)
        self.byte_ids = np.array(vocabulary.bytes)
        self.spelled = self.log_p[self.byte_ids]
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # per length: hashes (sorted), ids, code points
        by_length: dict[int, list[int]] = {}
        for i in vocabulary.plain:
            by_length.setdefault(len(vocabulary.pieces[i]), []).append(i)
        for n, ids in by_length.items():
            codes = np.frombuffer("".join(vocabulary.pieces[i] for i in ids).encode("utf-32-le"), np.uint32)
            at = np.arange(0, len(codes), n)
            h = common.window(common.prefix(codes, _BASE), at, at + n, _BASE)
            order = np.argsort(h)
            self.tables[n] = (h[order], np.array(ids)[order], codes.reshape(-1, n)[order])
        self.longest = max(self.tables, default=1)

    def spelling(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of characters as byte pieces."""
        distinct, inverse = np.unique(codes, return_inverse=True)
        return np.array([sum(self.spelled[b] for b in chr(c).encode()) for c in distinct.tolist()])[inverse].reshape(codes.shape)

    def arcs(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """words: code points, a row a word of the same length. Per piece length, the piece that ends at each place, or -1."""
        w, n = words.shape
        flat = np.ascontiguousarray(words).ravel()
        sums, out = common.prefix(flat, _BASE), {}
        for k, (hashes, ids, codes) in self.tables.items():
            if k > n:
                continue
            first = (np.arange(w)[:, None] * n + np.arange(n - k + 1)).ravel()
            h = common.window(sums, first, first + k, _BASE)
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            hit = hit[(flat[first[hit][:, None] + np.arange(k)] == codes[at[hit]]).all(1)]
            if len(hit):
                out[k] = np.full((w, n), -1, np.int32)
                out[k].ravel()[first[hit] + k - 1] = ids[at[hit]]
        return out

    def forward(self, words: np.ndarray, arcs: dict[int, np.ndarray], spelled: np.ndarray) -> np.ndarray:
        """Log probabilities of all ways to each place of each word."""
        w, n = words.shape
        alpha = np.zeros((n + 1, w))
        for end in range(1, n + 1):
            ways = [alpha[end - 1] + spelled[:, end - 1]]
            for k, ids in arcs.items():
                own = ids[:, end - 1]
                if k <= end and (own >= 0).any():
                    ways.append(np.where(own >= 0, alpha[end - k] + self.log_p[own], -np.inf))
            if len(ways) == 1:
                alpha[end] = ways[0]
            else:
                ways = np.stack(ways)
                top = ways.max(0)
                alpha[end] = top + np.log(np.exp(ways - top).sum(0))
        return alpha

    def _rows(self, words: pa.Array):
        """(places of words in the column, their code points, a row a word), words of one length together."""
        marked = pc.binary_join_element_wise(pa.scalar(_MARK), words, "")
        codes = np.frombuffer("".join(marked.to_pylist()).encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(marked).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(sizes, kind="stable")
        for n in np.unique(sizes).tolist():
            own = order[np.searchsorted(sizes[order], n) : np.searchsorted(sizes[order], n, "right")]
            step = max(1, _CHARS // n)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                yield part, codes[starts[part][:, None] + np.arange(n)]

    def _blocks(self, codes: np.ndarray):
        """A long word in blocks of places: (first place, arcs that end there as [(length, piece)], spellings)."""
        for first in range(0, len(codes), _CHARS):
            yield self._block(codes, first)

    def _block(self, codes: np.ndarray, first: int):
        lead = min(first, self.longest - 1)
        part = codes[None, first - lead : first + _CHARS]
        into: list[list[tuple[int, int]]] = [[] for _ in range(part.shape[1] - lead)]
        for k, ids in self.arcs(part).items():
            for at in np.flatnonzero(ids[0, lead:] >= 0).tolist():
                into[at].append((k, int(ids[0, lead + at])))
        return first, into, self.spelling(part[0, lead:])

    def _forward_long(self, codes: np.ndarray) -> np.ndarray:
        alpha, exp, log = [0.0], math.exp, math.log
        for _, into, spelled in self._blocks(codes):
            for arcs, own in zip(into, spelled.tolist(), strict=True):
                ways = [alpha[-1] + own, *(alpha[-k] + self.log_p[i] for k, i in arcs)]
                top = max(ways)
                alpha.append(top + log(sum([exp(x - top) for x in ways])))
        return np.array(alpha)

    def scores(self, words: pa.Array) -> np.ndarray:
        """Log probability of all ways through the pieces, for each word of a column."""
        out = np.zeros(len(words))
        for own, codes in self._rows(words):
            if codes.shape[1] > _LONG:
                for i, row in zip(own.tolist(), codes, strict=True):
                    out[i] = self._forward_long(row)[-1]
            else:
                out[own] = self.forward(codes, self.arcs(codes), self.spelling(codes))[-1]
        return out

    def word(self, word: str) -> float:
        return float(self.scores(pa.array([word], pa.string()))[0])

    def expected(self, words: pa.Array, times: np.ndarray, into: np.ndarray) -> None:
        """Adds to `into` how often each piece is expected in the words, each of which stands there `times` times."""

        def spell(codes: np.ndarray, weights: np.ndarray) -> None:
            distinct, inverse = np.unique(codes, return_inverse=True)
            for c, x in zip(distinct.tolist(), np.bincount(inverse, weights).tolist(), strict=True):
                for b in chr(c).encode():
                    into[self.byte_ids[b]] += x

        for own, codes in self._rows(words):
            if codes.shape[1] > _LONG:
                for i, row in zip(own.tolist(), codes, strict=True):
                    self._expected_long(row, float(times[i]), into, spell)
                continue
            arcs, spelled = self.arcs(codes), self.spelling(codes)
            alpha, n = self.forward(codes, arcs, spelled), codes.shape[1]
            share = np.zeros_like(alpha)  # how often a segmentation passes a place
            share[n] = times[own]
            for end in range(n, 0, -1):
                q = share[end] * np.exp(alpha[end - 1] + spelled[:, end - 1] - alpha[end])
                share[end - 1] += q
                spell(codes[:, end - 1], q)
                for k, ids in arcs.items():
                    here = ids[:, end - 1]
                    hit = np.flatnonzero(here >= 0) if k <= end else ()
                    if len(hit):
                        q = share[end, hit] * np.exp(alpha[end - k, hit] + self.log_p[here[hit]] - alpha[end, hit])
                        share[end - k, hit] += q
                        into[: self.size] += np.bincount(here[hit], q, self.size)

    def _expected_long(self, codes: np.ndarray, times: float, into: np.ndarray, spell) -> None:
        alpha, share = self._forward_long(codes), np.zeros(len(codes) + 1)
        share[-1] = times
        for first in range((len(codes) - 1) // _CHARS * _CHARS, -1, -_CHARS):
            _, arcs, spelled = self._block(codes, first)
            by_bytes = np.zeros(len(spelled))
            for at in range(len(spelled) - 1, -1, -1):
                end = first + at + 1
                by_bytes[at] = q = share[end] * math.exp(alpha[end - 1] + spelled[at] - alpha[end])
                share[end - 1] += q
                for k, i in arcs[at]:
                    q = share[end] * math.exp(alpha[end - k] + self.log_p[i] - alpha[end])
                    share[end - k] += q
                    into[i] += q
            spell(codes[first : first + len(spelled)], by_bytes)


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def _words(column: pa.Array):
    """The words of each text: lower-case A-Z, split at the contract's white space."""
    data, at = common.utf8(column)
    raw, at = memoryview(data), at.tolist()
    for s, e in zip(at[:-1], at[1:], strict=True):
        yield bytes(raw[s:e]).lower().split()


def _counted(batches):
    """Partial (word, train, total) counts; what is held stays bounded."""
    train, other = Counter(), Counter()

    def flush():
        words = [*train, *(w for w in other if w not in train)]
        out = [pa.array([w.decode() for w in words], pa.string()), pa.array([train[w] for w in words], pa.int64()), pa.array([train[w] + other[w] for w in words], pa.int64())]
        train.clear()
        other.clear()
        return pa.RecordBatch.from_arrays(out, names=["word", "train", "total"])

    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            part = batch.slice(at, _SLICE)
            for held, words in zip(part.column("held_out").to_pylist(), _words(part.column("text")), strict=True):
                (other if held else train).update(words)
            if len(train) + len(other) > _FLUSH:
                yield flush()
    yield flush()


def _learned(words: DataFrame, ends: int, model: bytes) -> np.ndarray:
    """Log probabilities of pieces and of the end (the last) from all training words (word, train) and the number of
    texts: the tokenizer's segmentations, then one EM step."""

    def summed(count):
        def run(batches):
            v, seen = Vocabulary(model), None
            seen = np.zeros(v.size)
            for batch in batches:
                for at in range(0, batch.num_rows, 8192):
                    part = batch.slice(at, 8192)
                    count(v, part.column("word"), part.column("train").to_numpy().astype(np.float64), seen)
            known = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array(seen[known], pa.float64())], names=["piece", "times"])

        seen = np.zeros(own.size + 1)
        for r in words.mapInArrow(run, "piece int, times double").groupBy("piece").agg(F.sum("times").alias("times")).collect():  # a row per piece at most
            seen[r.piece] = r.times
        seen[own.size] = ends
        return own.log_probabilities(seen)

    def segmented(v, texts, times, seen):
        ids = v.processor.encode(texts.to_pylist(), num_threads=1)
        each = np.fromiter((i for x in ids for i in x), np.int64)
        seen += np.bincount(each, np.repeat(times, [len(x) for x in ids]), v.size)

    own = Vocabulary(model)
    first = words.sparkSession.sparkContext.broadcast(summed(segmented))

    def weighed(v, texts, times, seen):
        if not hasattr(v, "lattice"):
            v.lattice = Lattice(v, first.value)
        v.lattice.expected(texts, times, seen)

    return summed(weighed)


def scored(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, mixed_score) of every row of docs.

    score is the marginal over all segmentations into pieces, mixed_score the one with whole-word arcs.

    Null and empty texts hold the end alone. A null doc_id is not held out. Repeated rows count as often as they
    stand there and give a row each. Columns of other names are not looked at.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:  # the driver's copy is sent along; executors need no file
        model = f.read()
    rows = docs.select("doc_id", "text", F.coalesce(fold() == HELD, F.lit(False)).alias("held_out"))
    counts = rows.select("text", "held_out").mapInArrow(_counted, "word string, train long, total long")
    counts = common.staged(counts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("total").alias("total")), "lm-counts")
    n_docs = rows.where(~F.col("held_out")).count()
    tokens, distinct = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1))).first()
    tokens, distinct = tokens + n_docs, distinct + (n_docs > 0)
    base = lambda c: math.log10((c + 1) / (tokens + distinct + 1))

    sent = spark.sparkContext.broadcast((model, _learned(counts.where("train > 0").select("word", "train"), n_docs, model)))
    end_score, end_mixed, end_base, end_known = float(sent.value[1][-1]) / math.log(10), math.log10(max(n_docs, 1) / max(tokens, 1)), base(n_docs), int(n_docs > 0)
    floor = DISCOUNT * (distinct - (n_docs > 0)) / max(tokens, 1)  # the weight of the ways through the pieces

    def probabilities(batches):
        model, log_p = sent.value
        lattice = Lattice(Vocabulary(model), log_p)
        for batch in batches:
            c = batch.column("train").to_numpy()
            log_pieces = np.concatenate([np.zeros(0), *(lattice.scores(batch.column("word").slice(at, 8192)) for at in range(0, batch.num_rows, 8192))])
            with np.errstate(divide="ignore"):
                mixed = np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / max(tokens, 1)), math.log(floor or 1) + log_pieces) / math.log(10)
            base = np.log10((c + 1) / (tokens + distinct + 1))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("total"), pa.array(c > 0), pa.array(base), pa.array(log_pieces / math.log(10)), pa.array(mixed)], names=["word", "total", "known", "base", "score", "mixed"])

    words = counts.mapInArrow(probabilities, "word string, total long, known boolean, base double, score double, mixed double")
    words = common.staged(words, "lm-words")
    top = words.orderBy(F.desc("total"), "word").limit(frequent).toArrow()
    table = {w.encode(): x for w, *x in zip(*(top.column(c).to_pylist() for c in ("word", "known", "base", "score", "mixed")), strict=True)}
    common_words = spark.sparkContext.broadcast(table)

    def parts(batches):
        table, n, task = common_words.value, 0, TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                out = {k: [] for k in ("row", "n_tokens", "n_known", "base", "score", "mixed", "rare")}
                for all_words in _words(batch.column("text")):
                    known, base, score, mixed, rare = end_known, end_base, end_score, end_mixed, []
                    for w, times in Counter(all_words).items():
                        x = table.get(w)
                        if x is None:
                            rare.append({"word": w.decode(), "times": times})
                        else:
                            known += times * x[0]
                            base += times * x[1]
                            score += times * x[2]
                            mixed += times * x[3]
                    for k, v in zip(out, ((task << 40) + n, len(all_words) + 1, known, base, score, mixed, rare), strict=True):
                        out[k].append(v)
                    n += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.string()), ("times", pa.int64())])))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=["doc_id", "held_out", *out])

    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.mapInArrow(parts, f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, mixed double, rare array<struct<word:string,times:long>>")
    texts = common.staged(texts, "lm-texts")
    rare = texts.select("row", F.explode("rare").alias("x")).select("row", "x.word", "x.times")
    numbers = words.select("word", "known", F.col("base").alias("b"), F.col("score").alias("s"), F.col("mixed").alias("m"))
    rare = rare.hint("merge").join(numbers, "word")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.col("known").cast("long")).alias("k"), F.sum(F.col("times") * F.col("b")).alias("b"), F.sum(F.col("times") * F.col("s")).alias("s"), F.sum(F.col("times") * F.col("m")).alias("m"))
    out = texts.drop("rare").hint("merge").join(rare, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + zero("k")).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b")).alias("base_score"),
        (F.col("score") + zero("s")).alias("score"),
        (F.col("mixed") + zero("m")).alias("mixed_score"),
    )
