import random
import re

import numpy as np
import pyarrow as pa
import pytest

from verdigraph.llm import jaccard

SCHEMA = "doc_id long, text string, node string, n long, a int, component string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(docs)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        named = [docs[i][0] for i in members if docs[i][0] is not None]
        out += [(docs[i][0], len(sets[i]), min(named) if named else None) for i in members]
    return sorted(out, key=repr)


def corpus(seed, n, size, families=6, passage=0, changes=6):
    """Families of texts that differ by some words, so that similarities fall on both sides of the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    shared = [rng.choice(vocabulary) for _ in range(passage)]
    heads = [[rng.choice(vocabulary) for _ in range(size)] for _ in range(families)]
    out = []
    for i in range(n):
        w = list(rng.choice(heads))
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            w = w[: rng.randrange(1, len(w))]
        if rng.random() < 0.3:
            w = shared + w
        out.append((i * 7 % 1009, " ".join(w)))
    return out


def got(spark, docs, **more):
    frame = spark.createDataFrame([(d, t, "x", 3, 1, "y") for d, t in docs], SCHEMA)
    return sorted((tuple(r) for r in jaccard.classes(frame, **more).collect()), key=repr)


@pytest.mark.parametrize(("seed", "size", "passage"), [(1, 120, 0), (2, 40, 30), (3, 9, 0), (4, 150, 60)])
def test_components_equal_brute_force(spark, seed, size, passage):
    docs = corpus(seed, 220, size, passage=passage)
    assert got(spark, docs) == brute(docs)


def test_large_blocks_are_cut_into_pieces(spark):
    docs = corpus(5, 260, 80, families=3, passage=40, changes=14)
    assert got(spark, docs, block_rows=24) == brute(docs)


def test_chance_links_at_the_threshold(spark):
    words = [f"t{i}" for i in range(103)]
    docs = [(9, " ".join(words))]
    for i in range(1, 30):  # sets of 100 - i of the 100 shingles: similar down to 85 of 100
        docs.append((100 + i, " ".join(words[: 103 - i])))
    docs += [(1, " ".join(words[16:]))]
    assert got(spark, docs) == brute(docs)


def test_odd_rows(spark):
    docs = [(5, None), (4, ""), (3, " \t\n"), (8, "One two"), (2, "one\x0bTWO"), (None, "one two"), (7, "one two three"), (8, "one two"), (None, "alone here"), (6, "É é x y"), (11, "é É x y")]
    assert got(spark, docs) == brute(docs)
    assert got(spark, docs[:1]) == [(5, 0, 5)]
    frame = spark.createDataFrame([], SCHEMA)
    assert jaccard.digest(frame).collect() == []
    assert jaccard.digest(frame).columns == ["doc_id", "n_shingles", "component_id"]


def test_very_long_texts_and_many_copies(spark):
    long = " ".join(f"v{i % 50_021}" for i in range(150_000))
    docs = [(1, long), (2, long.replace("v17 ", "changed ", 1)), (3, "short one")] + [(10 + i, "the same text of copies") for i in range(300)]
    want = [(1, 50_021, 1), (3, 1, 3)] + [(10 + i, 2, 10) for i in range(300)]
    found = got(spark, docs)
    assert [r for r in found if r[0] != 2] == sorted(want, key=repr)
    assert [r[2] for r in found if r[0] == 2] == [1]


def test_traversal_finds_every_similar_pair():
    rng = np.random.default_rng(7)
    base = [rng.integers(0, 1 << 63, 60, dtype=np.uint64) for _ in range(5)]
    sets = []
    for i in range(400):
        x = base[i % 5].copy()
        k = rng.integers(0, 12)
        x[:k] = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        sets.append(np.unique(x[: rng.integers(30, 61)]))
    bits = np.frombuffer(b"".join(jaccard._bitmaps(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])), np.uint64).reshape(-1, jaccard.BITS // 64)
    sizes, groups = np.array([len(s) for s in sets]), np.arange(400)
    tree = jaccard.SignatureTree(bits, sizes, groups)
    found = {(min(a, b), max(a, b)) for p, q in jaccard.traverse(tree, tree) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    similar = {(i, j) for i in range(400) for j in range(i + 1, 400) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert similar <= found
    assert len(found) < 400 * 399 // 2 // 3
    one, two = jaccard.SignatureTree(bits[:9], sizes[:9], groups[:9], 4), jaccard.SignatureTree(bits[9:], sizes[9:], groups[9:], 4)
    cross = {(a, b + 9) for p, q in jaccard.traverse(one, two) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    assert {x for x in similar if x[0] < 9 <= x[1]} <= cross
    assert not list(jaccard.traverse(*[jaccard.SignatureTree(bits, sizes, groups * 0)] * 2))


def test_shingle_hashes_do_not_depend_on_what_is_around():
    texts = ["a b c d e", "x", "b c d e", None, "B  c\td e", "x y"]
    parts = [(g[s:e].tolist()) for g, at in jaccard.shingle_sets(pa.array(texts)) for s, e in zip(at[:-1], at[1:], strict=True)]
    assert parts[2] == parts[4] and set(parts[2]) < set(parts[0]) and parts[3] == [] and len(parts[5]) == 1 and parts[1] != parts[5]
