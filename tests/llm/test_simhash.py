import numpy as np
import xxhash

from verdigraph.llm import simhash


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        named = [ids[i] for i in members if ids[i] is not None]
        for i in members:
            out[i] = min(named) if named else None
    return out


def clusters(rng, n):
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    out = set()
    while len(out) < n:
        x = int(rng.choice(base))
        for b in rng.integers(0, 64, int(rng.integers(0, 5))):
            x ^= 1 << int(b)
        out.add(x)
    return np.array(sorted(out), np.uint64)


def test_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    codes = clusters(rng, 300)
    index = simhash.GrayIndex(codes)
    who, found = index.search(index.codes, 2)
    got = set(zip(who.tolist(), found.tolist(), strict=True))
    want = {(i, j) for i, x in enumerate(index.codes) for j, y in enumerate(index.codes) if bin(int(x) ^ int(y)).count("1") <= 2}
    assert got == want


def test_links_connect_what_pairs_connect_also_when_blocks_are_dealt_again(spark):
    codes = clusters(np.random.default_rng(2), 400)
    want = brute_components(list(range(400)), [int(x) for x in codes])
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    for block_rows in (10_000, 30):
        links = [(r.a, r.b) for r in simhash.links(df, block_rows=block_rows).collect()]
        place = {int(x): i for i, x in enumerate(codes.view(np.int64))}
        root = list(range(400))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            i, j = find(place[a]), find(place[b])
            root[max(i, j)] = min(i, j)
        assert [find(i) for i in range(400)] == [want[i] for i in range(400)]


def test_digest_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = ["alpha", "Beta", "GAMMA", "dé", "x"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(1, 6, 120)]
    texts += [None, "", " \n\t ", "one", "one two", "One  TWO", "ÄÖ äö z", "long " * 5000, "long " * 4999 + "end"]
    ids = [*range(5, 5 + len(texts) - 2), None, 7]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").withColumns({"fp": simhash.F.lit(1), "component": simhash.F.lit("x")})
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.digest(df).collect())
    fps = [brute_fp(t) for t in texts]
    comp = brute_components(ids, fps)
    want = sorted((i is None, i or 0, f"{f:016x}", comp[k]) for k, (i, f) in enumerate(zip(ids, fps, strict=True)))
    assert got == want


def test_one_row_of_each_component_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (9, "completely other words stand here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or -1) for r in simhash.deduplicated(df).collect()) == [-1, 1, 9]
    assert simhash.deduplicated(df.limit(0)).columns == ["doc_id", "text"]
    assert simhash.digest(df.limit(0)).collect() == []
