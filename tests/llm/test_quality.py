import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verdigraph.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(repeated)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def fixture():
    rng = random.Random(6)
    lexicon = ["ab", "cdé", "x#", "|", "日本", "w*w", " q", "t t"]
    line = lambda k: rng.choice(["", " "]) + rng.choice([" ", "\t", "  ", "\x0b"]).join(rng.choice(lexicon) for _ in range(k))
    texts = ["\n".join(rng.choice([line(rng.randint(0, 9)), "same line", "same line "]) for _ in range(rng.randint(0, 25))) for _ in range(200)]
    return texts + [None, "", "\n \n", "a", "a b c a b c", "a b c d", "aa aa aa aa", "longest " * 30000, "x" * 2_000_000]


def test_statistics_against_brute_force():
    texts = fixture()
    c = quality.statistics(pa.array(texts, pa.string()))
    failed = quality.base_failed(c)
    for i, t in enumerate(texts):
        assert (*(int(c[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), bool(failed[i])) == brute(t)


def test_forest_paths_against_a_walk_and_outliers_score_higher():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(500, 3)), [[9.0, 9, 9], [-8, 9, 0]]]
    forest = quality.grown(x, trees=40, subsample=64)

    def walk(t, row):
        node = 0
        while forest.feature[t, node] >= 0:
            node = forest.child[t, node] + (row[forest.feature[t, node]] >= forest.split[t, node])
        return forest.path[t, node]

    score = forest.score(x)
    for i in (0, 7, 500):
        assert np.isclose(score[i], 2 ** (-np.mean([walk(t, x[i]) for t in range(40)]) / forest.norm))
    assert score[500:].min() > np.quantile(score[:500], 0.98)


def test_threshold_minimises_wrong_verdicts():
    rng = np.random.default_rng(2)
    score, good = rng.random(200), rng.random(200) < 0.7
    cut = quality.calibrated(score, good)
    wrong = lambda c: int(((score > c) & good).sum() + ((score <= c) & ~good).sum())
    assert wrong(cut) == min(wrong(c) for c in [-1.0, *score])
    assert quality.calibrated(score, np.ones(200, bool)) == 1.0


def test_query_with_odd_rows(spark):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(60, 300)))
    docs = [(i, good() if i % 8 else good().replace(" ", "*** ").upper()) for i in range(300)] + [(None, good()), (1, docs_text := good()), (900, None), (901, ""), (902, docs_text)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("quality", F.lit(5))
    labels = spark.createDataFrame([(i, int(i % 8 > 0)) for i in range(300)] + [(None, 0), (3, None)], "doc_id long, quality int").withColumn("text", F.lit(1))
    got = quality.digest(df, labels).collect()
    assert len(got) == len(docs)
    own = [r for r in got if r.doc_id is not None and 1 < r.doc_id < 300]
    assert sum(r.kept == bool(r.doc_id % 8) for r in own) / len(own) > 0.95
    assert all(not r.kept for r in got if r.base_failed)
    assert quality.digest(df.limit(0), labels).collect() == []
    assert all(r.kept != r.base_failed for r in quality.digest(df, labels.limit(0)).collect())


def test_threshold_is_calibrated_on_all_labelled_rows(spark):
    rng = np.random.default_rng(5)
    score, good = np.round(rng.random(900), 4), rng.random(900) < 0.5
    good = good | (score < 0.4)
    rows = spark.createDataFrame([(float(s), bool(g)) for s, g in zip(score, good, strict=True)], "score double, good boolean").repartition(5)
    cut = quality._cut(rows)
    wrong = lambda t: int((good & (score > t)).sum() + (~good & (score <= t)).sum())
    assert wrong(cut) == min(map(wrong, [-1.0, *score]))
    assert quality._cut(rows.where("good")) == 1.0 == quality._cut(rows.limit(0)) and quality._cut(rows.where("not good")) < score[~good].min()
    texts = [(i, " ".join(f"w{rng.integers(200)}" for _ in range(60 + i % 50)) + ("!" * 90 if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i, _ in texts], "doc_id long, quality int")
    few, flipped = quality.fitted(docs, labels, 50), quality.fitted(docs, labels.withColumn("quality", 1 - F.col("quality")), 50)
    assert few.threshold < 1  # the trees see 50 rows, the threshold all of them
    kept = {r.doc_id for r in quality.judged(docs, few).where("kept").collect()}
    assert len(kept ^ {i for i, _ in texts if i % 4}) <= 40 and flipped.threshold != few.threshold
