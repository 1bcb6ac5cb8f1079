import pytest

from verdigraph.llm import mixing


def brute_targets(sizes, names):
    weights = [(5, 2, 1)[k % 3] for k in range(len(names))]
    left, open_ = 1.5 * sum(sizes), set(range(len(names)))
    target = [0.0] * len(names)
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        for i in open_:
            target[i] += left * weights[i] / total
        left = 0.0
        for i in list(open_):
            if target[i] >= 2 * sizes[i]:
                left += target[i] - 2 * sizes[i]
                target[i] = 2.0 * sizes[i]
                open_.discard(i)
    return target


def table(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), f"s{i % 5}") for i in range(400)]
    rows += [(1000 + i, "x\ty z " * 40, "hot") for i in range(300)]
    rows += [(None, "a b c", None), (1500, None, "s1"), (1501, "", "empty"), (7, "dup dup", "s2"), (7, "dup dup", "s2"), (8, "word " * 20000, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash")).withColumn("src", mixing.F.lit(1))


def test_targets_taken_and_reruns(spark):
    rows, df = table(spark)
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    count = lambda t: len((t or "").encode().split())
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + count(text)
    names = [*sorted(s for s in sizes if s is not None), None]
    want = dict(zip(names, brute_targets([sizes[n] for n in names], names), strict=True))
    by_id = {}
    for i, text, source in rows:
        by_id.setdefault(i, []).append((count(text), source))
    taken = dict.fromkeys(names, 0)
    for r in got:
        size, source = next(x for x in by_id[r.doc_id] if x[0] == r.size)
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * size
        taken[source] += r.taken
    for n in names:  # a slot, a short last block a pass, and the rounding of block edges to words
        assert abs(taken[n] - want[n]) <= 3 * mixing.LEAST_BLOCK + 0.002 * want[n]
    key = lambda r: (r.doc_id is None, *map(str, r))
    assert sorted(got, key=key) == sorted(mixing.mixed(df.repartition(7)).collect(), key=key)


def test_schedule_is_even(spark):
    _, df = table(spark)
    rows = mixing.sized(df).cache()
    sources = mixing.targets(rows).cache()
    slots = mixing.slots(sources, 10).collect()
    assert sorted(s.slot for s in slots) == list(range(1024))
    share = {s.src: s.target / s.budget for s in sources.collect()}
    for src, part in share.items():
        own = sorted((s.slot, s["rank"]) for s in slots if s.src == src)
        assert [r for _, r in own] == list(range(len(own)))
        for k in (64, 256, 1024):  # the discrepancy of van der Corput points
            assert abs(sum(s < k for s, _ in own) - part * k) <= 12


def test_empty_tables(spark):
    _, df = table(spark)
    assert mixing.mixed(df.limit(0)).collect() == []
    none = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mixed(none).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_blocks_stay_small_in_a_large_corpus(spark):
    """Above 2**20 slots too, blocks have LEAST_BLOCK words at most and small sources get their target."""
    large = spark.range(6000).select("id", mixing.F.expr("repeat('w ', 1000)").alias("text"), mixing.F.lit("large").alias("source"))
    small = spark.createDataFrame([(10_000 + i, "a b c d e f", s) for i in range(4) for s in ("small", None)], "id long, text string, source string")
    rows = mixing.common.staged(mixing.sized(large.unionByName(small).withColumnRenamed("id", "doc_id")), "test-sizes")
    sources = mixing.common.staged(mixing.targets(rows), "test-sources")
    words = mixing.F.col("to_word") - mixing.F.col("from_word")
    got = {r.src: r for r in mixing.plan(rows, sources).groupBy("src").agg(mixing.F.max(words).alias("block"), mixing.F.sum(words).alias("taken")).collect()}
    for s in sources.collect():
        assert got[s.src].block <= mixing.LEAST_BLOCK
        assert abs(got[s.src].taken - s.target) <= 2 * mixing.LEAST_BLOCK + 0.002 * s.target
