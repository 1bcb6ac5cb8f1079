import pickle
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.operators import inverted, matched, sparse
from verdigraph.operators.inverted import StoredIndex


def corpus(seed, n, words=300):
    """Texts whose words are as uneven as in language: a few are in nearly all of them."""
    rng = random.Random(seed)
    vocabulary = [f"palavra{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(n)]


def frame(spark, rows):
    """Documents with columns named like the index's own."""
    return spark.createDataFrame([(d, t, "x", 9, 1, "y") for d, t in rows], "doc_id long, text string, token string, size int, batch int, bucket string")


def asked(spark, texts):
    return sparse.tokenized(spark.createDataFrame(list(enumerate(texts)), "q long, text string"), "q")


def best(spark, docs, texts, k):
    """(question, document, rank, score) by scoring every pair."""
    tokens = sparse.indexed(frame(spark, docs), "doc_id")
    scored = sparse.scores(asked(spark, texts), tokens, "q", "doc_id")
    return scored, rows(sparse.top(scored, "q", "doc_id", F.round("bm25", 9), k))


def rows(found):
    return sorted((r.q, r["rank"], r.doc_id, round(r.bm25, 7)) for r in found.collect())


def content(index):
    counts = index.vocabulary().groupBy("token").agg(F.sum("df").alias("df")).collect()
    return sorted((r.token, r.doc_id, r.tf, r.size) for r in index.postings().collect()), sorted(map(tuple, counts)), index.statistics()


QUESTIONS = ["palavra3 palavra120 palavra250", "palavra0 palavra1 palavra2 palavra280", "palavra200", "palavra0", "unbekannt", "palavra40 palavra40 palavra41 " * 3]


@pytest.mark.parametrize("k", [1, 5, 200])
def test_top_equals_scoring_every_pair(spark, tmp_path, k):
    docs = corpus(1, 400)
    index = StoredIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(frame(spark, docs), 0)
    scored, want = best(spark, docs, QUESTIONS, k)
    assert rows(index.top(asked(spark, QUESTIONS), "q", k)) == want
    assert index.candidates(asked(spark, QUESTIONS), "q", k)[0].count() <= scored.count()


def test_few_pairs_are_scored(spark, tmp_path):
    docs = corpus(2, 3000, 1000)
    texts = [" ".join(t.split()[:5]) for _, t in docs[:40] if len(t.split()) > 4]  # questions of five words
    index = StoredIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(frame(spark, docs), 0)
    scored, want = best(spark, docs, texts, 5)
    assert rows(index.top(asked(spark, texts), "q", 5)) == want
    assert index.candidates(asked(spark, texts), "q", 5)[0].count() * 5 < scored.count()


def test_batches_leave_what_one_batch_of_the_last_versions_leaves(spark, tmp_path):
    first = corpus(3, 60)
    second = [(d, t + " palavra7 novidade") for d, t in corpus(4, 90) if d % 3 == 0] + [(1, None), (2, ""), (500, None)]
    third = [(1, "palavra1 de novo"), (3, None), (0, "palavra0")]
    index = StoredIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(frame(spark, first), 0)
    done = index.add(frame(spark, second), 1)
    assert done["removed"] == 2 and done["replaced"] == 22
    index.add(frame(spark, third), 2)
    latest = {}
    for d, t in first + second + third:
        latest[d] = t
    whole = StoredIndex(spark, str(tmp_path / "w"), buckets=4)
    whole.add(frame(spark, sorted(latest.items())), 0)
    assert content(index) == content(whole)
    docs = [(d, t) for d, t in latest.items() if t is not None]
    assert rows(index.top(asked(spark, QUESTIONS), "q", 5)) == best(spark, docs, QUESTIONS, 5)[1]


def test_a_batch_that_is_written_again_replaces_itself(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(frame(spark, corpus(5, 40)), 0)
    changed = frame(spark, corpus(6, 20))
    index.add(frame(spark, corpus(7, 25)), 1)  # what an attempt that failed left behind
    index.add(changed, 1)
    once = content(index)
    index.add(changed, 1)
    assert content(index) == once
    assert len(once[0]) == len({r[:2] for r in once[0]})


def test_odd_rows(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"), buckets=4)
    with pytest.raises(FileNotFoundError):
        index.postings()
    assert index.add(frame(spark, []), 0)["postings"] == 0
    assert content(index) == ([], [], (0, 1.0))
    index.add(frame(spark, [(None, "perdido"), (1, "ab"), (1, "cd cd"), (2, ""), (3, None), (4, "a o e")]), 1)
    found, _, (n, _) = content(index)
    assert [r for r in found if r[1] == 1] == [("cd", 1, 2, 2)] and n == 3
    assert not [r for r in found if r[0] == "perdido"]
    assert index.top(asked(spark, ["", "nada"]), "q", 3).count() == 0


def test_a_long_text(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(frame(spark, [(1, "longo " * 300_000 + "fim"), (2, "fim")]), 0)
    assert content(index)[0] == [("fim", 1, 1, 300_001), ("fim", 2, 1, 1), ("longo", 1, 300_000, 300_001)]


@pytest.mark.parametrize("k", [1, 5])
def test_many_questions_are_scored_together(spark, tmp_path, monkeypatch, k):
    docs = corpus(5, 700) + [(900 + i, "palavra3 palavra120") for i in range(9)] + [(950, None), (951, "")]  # equal scores
    texts = QUESTIONS + [t for _, t in corpus(6, 90, 400)]
    index = StoredIndex(spark, str(tmp_path))
    index.add(frame(spark, docs), 0)
    monkeypatch.setattr(StoredIndex, "candidates", lambda *a: pytest.fail("candidates of many questions are nearly all pairs"))
    monkeypatch.setattr(matched, "DOCUMENTS", 64)
    monkeypatch.setattr(matched, "QUESTIONS", 16)
    want = best(spark, docs, texts, k)[1]
    assert rows(index.top(asked(spark, texts), "q", k)) == want
    monkeypatch.setattr(matched, "CARRIED", 100)
    assert rows(index.top(asked(spark, texts), "q", k)) == want


def test_matched_scores_that_are_not_positive(spark, tmp_path):
    docs = [(1, "alfa beta"), (2, "alfa beta gama"), (3, "alfa beta"), (4, "alfa"), (5, "delta")]
    for name, kept in (("all", docs), ("negative", docs[:3]), ("zero", [docs[0], docs[4]])):
        index = StoredIndex(spark, str(tmp_path / name))
        index.add(frame(spark, kept), 0)
        texts = ["alfa", "alfa beta", "gama delta", "nada"]
        assert rows(index.matched(asked(spark, texts), "q", 2)) == best(spark, kept, texts, 2)[1]


def test_product_of_entries():
    rng = np.random.default_rng(3)
    a, b = rng.random((200, 40)) * (rng.random((200, 40)) < 0.6), rng.random((300, 40)) * (rng.random((300, 40)) < 0.6)
    a[:, 20:] *= rng.random((200, 20)) < 0.05  # rare tokens beside frequent ones
    side = lambda m, shift: matched.Side.of(len(m), *np.nonzero(m)[:1], np.nonzero(m)[1] * 7 + shift, m[np.nonzero(m)])
    assert np.allclose(matched.product(side(a, 0), side(b, 0)), a @ b.T)
    assert not matched.product(side(a, 0), side(b, 1)).any() and not matched.product(side(a[:, :0], 0), side(b, 0)).any()


def test_broadcast_values_are_added_with_numpys_own_type(monkeypatch):
    """What was pickled has a type object that is equal to numpy's but not the same; add.at is many times slower for it."""
    rng, kinds = np.random.default_rng(4), []
    m = rng.random((300, 50)) * (rng.random((300, 50)) < 0.15)  # too few pairs for columns
    own = pickle.loads(pickle.dumps(matched.Side.of(len(m), *np.nonzero(m)[:1], np.nonzero(m)[1], m[np.nonzero(m)])))
    assert own.value.dtype is not np.dtype(float)

    def at(out, place, value):
        kinds.append(value.dtype is np.dtype(out.dtype.type))
        np.add.at(out, place, value)

    monkeypatch.setattr(matched, "np", SimpleNamespace(**{**vars(np), "add": SimpleNamespace(at=at)}))
    assert np.allclose(matched.product(own, own), m @ m.T)
    assert kinds == [True]


@pytest.mark.parametrize("k", [1, 4])
def test_few_pairs_are_added_again(k):
    """Sums in single precision leave few pairs, the best among them; equal scores go by key."""
    rng = np.random.default_rng(8)
    asked, held = rng.random((60, 400)) * 9 * (rng.random((60, 400)) < 0.06), rng.random((900, 400)) * (rng.random((900, 400)) < 0.1)
    held[700:] = held[rng.integers(0, 700, 200)]  # copies
    held[5], asked[7] = 0, 0
    block = pickle.loads(pickle.dumps(matched.Block(60, *np.nonzero(asked), asked[np.nonzero(asked)])))
    best, room, again = matched.Best(60, k), np.empty(60 * 300, np.float32), 0
    for first in range(0, 900, 300):
        part = held[first : first + 300]
        docs = matched.Documents(np.arange(first, first + 300), *np.nonzero(part), part[np.nonzero(part)], 400)
        row, column = matched.hopeful(matched.single(block, docs, room), best.beat(), block.sure, k)
        again += len(row)
        best.offer(row, matched.exact(block, docs, row, column), docs.keys[column])
    whole = asked @ held.T
    assert again < 60 * 900 * (0.02 if k == 1 else 0.06)
    for i, own in enumerate(whole):
        want = [j for j in np.lexsort((np.arange(900), -np.round(own, 9))) if own[j] > 0][:k]
        assert [j for j, s in zip(best.key[i], best.score[i], strict=True) if np.isfinite(s)] == want
        assert np.allclose(best.score[i][: len(want)], own[want], rtol=1e-13)


def test_postings_travel_once(spark, tmp_path, monkeypatch):
    """Documents count their tokens in their own rows: what `counted` gives is what is stored."""
    real = inverted.counted
    monkeypatch.setattr(inverted, "counted", lambda tokens: F.transform(real(tokens), lambda x: F.struct(x["token"], (x["tf"] + 100).alias("tf"))))
    index = StoredIndex(spark, str(tmp_path))
    index.add(frame(spark, [(1, "alfa beta alfa"), (2, None), (3, "")]), 0)
    assert content(index)[0] == [("alfa", 1, 102, 3), ("beta", 1, 101, 3)]
