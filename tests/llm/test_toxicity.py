import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import toxicity

BAD = ["scumbag", "worthless", "pathetic"]
GOOD = ["river", "mountain", "quiet", "garden", "letter", "window", "paper", "summer"]


def rows(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = list(rng.choice(GOOD, int(rng.integers(5, 60))))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(1 + len(words) // 15):
                words[int(rng.integers(len(words)))] = str(rng.choice(BAD))
        out.append((i, " ".join(words), toxic))
    return out


def test_bag_against_plain_python():
    texts = ["One two, two éÉ", None, "", "x" * 3000 + " two"]
    b = toxicity.bag(texts)
    assert b.texts == 4
    counts = [sorted(b.count[b.text == i].tolist()) for i in range(4)]
    assert counts == [[1, 1, 2], [], [], [1, 1]]
    two = b.word[(b.text == 0) & (b.count == 2)][0]
    assert two in b.word[b.text == 3]
    # itself and ^tw, two, wo$, ^two, two$
    assert (b.word_of_gram == two).sum() == 1 + 3 + 2


def test_held_out_accuracy_and_misspellings():
    train, test = rows(800), rows(200, 1)
    model = toxicity.train([t for _, t, _ in train], [y for _, _, y in train])
    score = model.score([t for _, t, _ in test])
    y = np.array([y for _, _, y in test])
    assert ((score >= 0.5) == (y == 1)).mean() > 0.97
    clean, hidden = model.score(["quiet river garden letter summer paper", "quiet river worthlesss pathetik summer paper"])
    assert hidden > clean


def test_query_with_odd_rows(spark):
    data = rows(400)
    docs = [(i, t) for i, t, _ in data] + [(None, "river"), (900, None), (901, ""), (5, data[5][1]), (902, "garden " * 100_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(9))
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (3, None), (4, 1), (4, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.digest(df, labels).collect()
    assert len(got) == len(docs)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = toxicity.accepted(df, labels)
    assert kept.columns == df.columns
    assert kept.count() == sum(r.predicted == 0 for r in got)
    # labels of the held fold change nothing
    other = labels.withColumn("toxic", F.when(F.coalesce(toxicity.fold() == 0, F.lit(False)), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.digest(df, other).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)


def test_without_labels_or_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.digest(df, labels).collect()] == [0]
    assert toxicity.digest(df.limit(0), labels).collect() == []


def test_counted_features_train_the_same_model_as_texts(spark):
    data = [r for r in rows(600) if zlib.crc32(str(r[0]).encode()) % 5]
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    got = toxicity.fitted(df, labels)
    own = sorted(data, key=lambda r: str(r[0]))
    want = toxicity.train([t for _, t, _ in own], [y for *_, y in own])
    assert np.allclose(got.part, want.part, atol=1e-6) and got.bias == pytest.approx(want.bias)
    assert got.score(["quiet river scumbag"])[0] > got.score(["quiet river garden"])[0]
    few = toxicity.fitted(df, labels, train_pairs=sum(len(set(t.split())) for _, t, _ in data) // 2)
    assert not np.allclose(few.part, want.part)


def test_score_against_a_plain_sum():
    data = rows(300)
    model = toxicity.train([t for _, t, _ in data], [y for *_, y in data], epochs=5)
    for _, text, _ in data[:20]:
        words = text.split()
        total = mass = 0.0
        for w in sorted(set(words)):
            b = toxicity.bag([w])
            times = min(words.count(w), max(3, toxicity.MOST_PART * len(words)))
            weight = model.weights(b.hashes)[0]
            total += weight * times * model.part[b.grams].mean()
            mass += weight * times
        assert model.score([text])[0] == pytest.approx(1 / (1 + np.exp(-(total / (mass + toxicity.PRIOR) + model.bias))))


def test_training_holds_few_bytes_a_pair_and_stages_labels_alone(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i:05}" for i in range(20_000)])
    texts = [" ".join(vocabulary[rng.choice(len(vocabulary), 600, replace=False)]) for _ in range(1500)]
    labels = [int(i % 3 == 0) for i in range(len(texts))]
    monkeypatch.setattr(toxicity, "BLOCK", 1 << 14)
    counted, y = toxicity.counted_texts(texts), np.array(labels, float)
    tracemalloc.start()
    toxicity.learned(counted, y, epochs=1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25 * 600 * len(texts)  # what was counted is not part of it
    staged, was = [], toxicity.common.staged
    monkeypatch.setattr(toxicity.common, "staged", lambda df, name: staged.append(name) or was(df, name))
    data = rows(60)
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    toxicity.fitted(df, spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int"))
    assert staged == ["toxicity-labels"]
