import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        keep = np.ones(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                keep[i : i + length] = False
        spans = int((~keep[:1]).sum() + (keep[:-1] & ~keep[1:]).sum())
        out.append((bytes(b for b, k in zip(d, keep, strict=True) if k), len(d), int((~keep).sum()), spans))
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    letters = "abcdefgh é\n"
    line = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [line(k) for k in (90, 130, 150, 400, 99)]
    out = []
    for _ in range(n):
        out.append(line(rng.randint(0, 300)) + rng.choice(shared) + line(rng.randint(0, 200)) + rng.choice(["", rng.choice(shared)]))
    out += [out[3], out[3], out[4] + "x", "x" + out[4], out[5][:-1], None, "", "ab " * 300, "ab " * 299 + "q", "z" * 100, "z" * 101, "y" * 99, "uvw" * 40 + shared[0] + "uvw" * 45, line(20000) + shared[1]]
    return out


@pytest.mark.parametrize(("length", "near"), [(100, 16), (100, 1), (64, 2), (7, 16), (7, 0)])
def test_against_brute_force(spark, length, near):
    data = texts(length)
    df = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(data)], "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("ranges", F.lit(1)).repartition(5)
    got = Counter((bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in repeats.cleaned(df, length, near).collect())
    assert got == Counter(brute(data, length))


def test_contract_columns_and_empty_table(spark):
    text = "passage " * 3 + "".join(chr(97 + i * i % 23) for i in range(500))
    df = spark.createDataFrame([(1, text), (2, "own start " + text)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.digest(df).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (len(text), len(text), 1)
    assert repeats.digest(df.limit(0)).collect() == []


def test_merge_never_loses_order_or_prefixes():
    rng = random.Random(5)
    keys = sorted("".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(400))
    runs = [[] for _ in range(7)]
    for k in keys:
        runs[rng.randrange(7)].append(k)

    def entries(run):
        lcps, rest = repeats.front_coded(run)
        before, at = b"", 0
        for key, n in zip(run, lcps, strict=True):
            size = len(key) - n
            before, at = before[:n] + rest[at : at + size], at + size
            yield [before, n, None]

    merged = [(e[0], e[1]) for e in repeats.LoserTree([entries(r) for r in runs])]
    assert [k for k, _ in merged] == keys
    assert [n for _, n in merged] == [0, *(repeats._shared(a, b, 0) for a, b in zip(keys, keys[1:], strict=False))]


def test_hot_seeds_are_counted_by_their_strings_over_many_partitions(spark):
    rng = random.Random(11)
    line = lambda k: "".join(rng.choice("abcdefgh \n") for _ in range(k))
    shared, copy = line(130), line(400)
    data = [line(rng.randint(0, 150)) + shared + line(rng.randint(0, 150)) for _ in range(300)] + [copy] * 50 + [None, "", line(500)]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string").repartition(40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "53")
    try:
        got = Counter((bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in repeats.cleaned(df, 100, 16, 20).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == Counter(brute(data, 100))


def test_equal_hashes_of_unequal_strings_are_told_apart():
    data = np.frombuffer(b"abcabdabcabe" * 3, np.uint8)
    raw, n = data.tobytes(), len(data) - 3
    want, last = [], {}
    for i in range(n + 1):
        want.append(last.get(raw[i : i + 3], -1))
        last[raw[i : i + 3]] = i
    exact = np.array([hash(raw[i : i + 3]) & 0xFFFF_FFFF for i in range(n + 1)], np.uint64)
    assert repeats._earlier(data, exact, 3).tolist() == want
    assert repeats._earlier(data, exact % np.uint64(2), 3).tolist() == want


def test_remaining_text_is_a_column(spark):
    text = "".join(chr(97 + i * i % 23) for i in range(450))
    df = spark.createDataFrame([(1, "é" + text + "own"), (2, text), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.digest(df).collect()}
    assert (got[1].text, got[2].text, got[3].text) == ("éown", "", "")
    # the second byte of two characters agrees, the first does not
    df = spark.createDataFrame([(1, "\u00e9" + "x" * 0 + text), (2, "\u0169" + text)], "doc_id long, text string")
    got = {r.doc_id: r for r in repeats.digest(df).collect()}
    assert got[1].n_removed == got[2].n_removed == 451 and got[1].text == "\ufffd"
