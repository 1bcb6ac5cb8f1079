import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import lattice

DOCS = [(i, f"the Quick brown fox {'jumps' if i % 3 else 'leaps over'} word{i % 11} naïve\tthe") for i in range(60)]
DOCS += [(None, "the end"), (100, None), (101, ""), (5, DOCS[5][1]), (102, "lonely " * 20000), (103, "x" * 3000), (104, "中文 \u0000 ")]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def words(text):
    return (text or "").encode().lower().split()


@pytest.fixture(scope="module")
def vocabulary():
    with open(lattice.VOCABULARY, "rb") as f:
        return lattice.Vocabulary(f.read())


def brute_paths(vocabulary, log_p, text):
    """All segmentations, one by one: their number is small for short words."""
    pieces = {vocabulary.pieces[i]: log_p[i] for i in vocabulary.plain}

    def ways(at):
        if at == len(text):
            return [0.0]
        out = [sum(log_p[vocabulary.bytes[b]] for b in text[at].encode()) + w for w in ways(at + 1)]
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in pieces:
                out += [pieces[text[at:end]] + w for w in ways(end)]
        return out

    return math.log(sum(math.exp(w) for w in ways(0)))


def test_forward_recursion_against_all_segmentations(vocabulary):
    log_p = vocabulary.log_probabilities(np.zeros(vocabulary.size + 1))
    own = lattice.Lattice(vocabulary, log_p)
    for word in ("the", "fox,", "naïve", "a", "中x", "thanon"):
        assert own.word(word) == pytest.approx(brute_paths(vocabulary, log_p, "▁" + word))
    seen = np.zeros(vocabulary.size)
    own.expected(pa.array(["thanon", "fox"]), np.array([1.0, 2.0]), seen)
    length = sum(n * (1 if i in vocabulary.bytes else len(vocabulary.pieces[i])) for i, n in enumerate(seen))
    assert length == pytest.approx(len("▁thanon") + 2 * len("▁fox"), abs=1e-2)  # hardly any way spells the mark by its three bytes


def test_long_words_in_blocks(vocabulary, monkeypatch):
    log_p = vocabulary.log_probabilities(np.zeros(vocabulary.size + 1))
    own, words, times = lattice.Lattice(vocabulary, log_p), pa.array(["the" * 40 + "中é", "x" * 90, "the"]), np.array([1.0, 3.0, 1.0])
    want, seen = own.scores(words), np.zeros(vocabulary.size)
    own.expected(words, times, seen)
    monkeypatch.setattr(lattice, "_LONG", 20)
    monkeypatch.setattr(lattice, "_CHARS", 32)
    again = np.zeros(vocabulary.size)
    assert own.scores(words) == pytest.approx(want)
    own.expected(words, times, again)
    assert again == pytest.approx(seen)


def test_score_against_brute_force(spark, vocabulary):
    data = [(i, t) for i, t in DOCS if t is None or len(t) < 100]
    got = {(r.doc_id, r.held_out): r for r in lattice.scored(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    count = Counter(w.decode() for i, t in data if not held(i) for w in words(t))
    first = np.zeros(vocabulary.size + 1)
    for w, n in count.items():
        for i in vocabulary.processor.encode(w):
            first[i] += n
    first[-1] = ends = sum(not held(i) for i, _ in data)
    log_p = vocabulary.log_probabilities(first)
    second = np.zeros(vocabulary.size + 1)
    second[-1] = ends
    lattice.Lattice(vocabulary, log_p).expected(pa.array(list(count)), np.array(list(count.values()), np.float64), second[:-1])
    log_p = vocabulary.log_probabilities(second)
    for i, t in data:
        if "\0" not in (t or ""):
            want = log_p[-1] + sum(brute_paths(vocabulary, log_p, "▁" + w.decode()) for w in words(t))
            assert got[i, held(i)].score == pytest.approx(want / math.log(10))


@pytest.mark.parametrize("frequent", [0, 5, 1000])
def test_base_against_brute_force_however_words_are_split(spark, frequent):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("word", F.lit(1))
    got = sorted((str(r.doc_id), *r[1:]) for r in lattice.scored(df, frequent=frequent).collect())
    count = Counter(w for i, t in DOCS if not held(i) for w in words(t))
    end = sum(not held(i) for i, _ in DOCS)
    total, distinct = sum(count.values()) + end, len(count) + 1
    want = []
    for i, t in DOCS:
        c = [*(count[w] for w in words(t)), end]
        want.append((str(i), held(i), len(c), sum(x > 0 for x in c), total, sum(math.log10((x + 1) / (total + distinct + 1)) for x in c)))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5])
        assert -math.inf < g[6] < 0 and -math.inf < g[7] < 0


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.scored(df).collect() == []
