import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigraph.operators import cells, dense
from verdigraph.operators.matched import leading

SCHEMA = "v long, embedding array<float>, cell int, near double, vector string"


def frame(spark, x, keys=None):
    keys = range(len(x)) if keys is None else keys
    return spark.createDataFrame([(int(k), None if r is None else [float(c) for c in r], 1, 0.5, "x") for k, r in zip(keys, x, strict=True)], SCHEMA)


def asked(df, every):
    return df.where(F.col("v") % every == 0).select(F.col("v").alias("q"), "embedding")


def rows(df):
    return sorted((r.q, r["rank"], r.v, round(r.dense_score, 6)) for r in df.collect())


def clustered(n, dim, groups, spread):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(groups, dim))
    return middle[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("probes", [1, 4])
def test_exact_search_equals_comparing_all(spark, monkeypatch, probes):
    monkeypatch.setattr(cells, "CELL_ROWS", 40)
    monkeypatch.setattr(cells, "QUERY_ROWS", 7)
    df = frame(spark, clustered(600, 12, 9, 0.4))
    index = cells.built(df, "v", 16)
    assert rows(cells.near_top(asked(df, 5), index, "q", 6, probes, exact=True)) == rows(dense.cosine_top(asked(df, 5), df, "q", "v", 6))


@pytest.mark.parametrize("given", [True, False])
def test_recall_reaches_what_was_asked_for(spark, given):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumnRenamed("vec_id", "v") if given else frame(spark, clustered(1500, 16, 40, 0.25))
    index = cells.built(df, "v")
    exact = dense.cosine_top(asked(df, 20), df, "q", "v", 10)
    probes = cells.probes_for(asked(df, 7), index, "q", 10, 0.97)
    assert cells.recall(cells.near_top(asked(df, 20), index, "q", 10, probes), exact, "q", "v") >= 0.95
    assert probes < (64 if given else 12)  # the given vectors are drawn at random and form no clusters


def test_one_cell_holds_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(cells, "CELL_ROWS", 30)
    x = clustered(300, 8, 20, 0.2)
    x[:100] = x[0]  # equal vectors: ties go to the smaller keys
    df = frame(spark, x, reversed(range(300)))
    index = cells.built(df, "v", 12)
    assert rows(cells.near_top(asked(df, 3), index, "q", 5, 2, exact=True)) == rows(dense.cosine_top(asked(df, 3), df, "q", "v", 5))


@pytest.mark.parametrize("exact", [True, False])
def test_a_task_holds_few_cosines_however_many_rows_meet(spark, monkeypatch, exact):
    df = frame(spark, clustered(400, 8, 3, 0.2))
    index = cells.built(df, "v", 4)
    want = rows(cells.near_top(asked(df, 2), index, "q", 5, 3, exact=exact))
    whole = cells.leading

    def bounded(ranked, k):
        assert ranked.size <= 700, ranked.shape  # at least one query at a time, of at most 400 vectors
        return whole(ranked, k)

    monkeypatch.setattr(cells, "leading", bounded)
    monkeypatch.setattr(cells, "COSINES", 700)
    monkeypatch.setattr(cells, "PROBED_ROWS", 9)
    assert rows(cells.near_top(asked(df, 2), index, "q", 5, 3, exact=exact)) == want


def test_leading_takes_the_first_of_equal_values():
    assert leading(np.array([[0.0, 1, 1, 0, 1], [2, 0, 2, 3, 2]]), 2).tolist() == [[1, 2], [0, 3]]
    assert leading(np.array([[3.0, 1]]), 5).tolist() == [[0, 1]]


def test_odd_rows(spark):
    df = frame(spark, [[0, 0, 0], [1, 0, 0], None, [0, 1, 0], [-1, 0, 0], [0, 0, 2]])
    index = cells.built(df, "v", 64)  # more cells than vectors
    assert rows(cells.near_top(asked(df, 1), index, "q", 3, 1, exact=True)) == rows(dense.cosine_top(asked(df, 1), df, "q", "v", 3))
    empty = cells.built(df.limit(0), "v")
    assert cells.near_top(asked(df, 1), empty, "q", 3).collect() == []
    assert cells.near_top(asked(df.limit(0), 1), index, "q", 3).collect() == []
    with pytest.raises(ValueError, match="positive"):
        cells.near_top(df, index, "v", 0)
    only = cells.built(frame(spark, [None, None]), "v")
    assert not len(only.centres)


def test_the_sample_is_bounded_and_every_vector_indexed(spark):
    df = frame(spark, clustered(500, 6, 5, 0.5))
    index = cells.built(df, "v", 8, fit_rows=50)
    assert len(index.centres) == 8 and index.vectors.count() == 500
    again = cells.built(df.repartition(7), "v", 8, fit_rows=50)
    assert np.array_equal(index.centres, again.centres)
