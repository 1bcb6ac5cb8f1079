import pytest
from pyspark.sql import functions as F

from verdigraph.sources import documents as store
from verdigraph.streaming.ingest import read_store, upsert_stream

SCHEMA = "chunk_id string, text string, bucket int, batch string"


def frame(spark, rows):
    return spark.createDataFrame([(c, t, 1, "x") for c, t in rows], SCHEMA)


def content(spark, path):
    return sorted((r.chunk_id, r.text) for r in read_store(spark, path).collect())


def files(path):
    return {str(p.relative_to(path)): p.stat().st_size for p in path.rglob("part-*")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    store.put(frame(spark, [(f"c{i}", f"text {i} " * 50) for i in range(2000)]), path, 0)
    before = files(tmp_path / "s" / "store")
    touched = store.put(frame(spark, [("c7", "new"), ("fresh", "new")]), path, 1)
    after = files(tmp_path / "s" / "store")
    assert len(touched) == 2
    written = {f for f in after if f not in before}
    assert {f.split("/")[0] for f in written} == {f"chunk_bucket={b}" for b in touched}
    assert sum(after[f] for f in written) < sum(before.values()) / 10
    assert sum(files(tmp_path / "s" / "changes" / "change_batch=1").values()) < 10_000
    found = dict(content(spark, path))
    assert found["c7"] == found["fresh"] == "new" and len(found) == 2001


def test_a_repeated_batch_leaves_one_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    first, second = [("a", "1"), ("b", "1"), ("c", "1")], [("b", "2"), ("d", "2"), ("d", "3"), (None, "x"), ("e", None)]
    want = [("a", "1"), ("b", "2"), ("c", "1"), ("d", "3")]
    store.put(frame(spark, first), path, 0, 4)
    store.put(frame(spark, second), path, 1, 4)
    assert content(spark, path) == want
    store.put(frame(spark, second), path, 1, 4)
    assert content(spark, path) == want
    # an attempt that lost some of the store's buckets while it replaced them
    for f in (tmp_path / "s" / "store").glob("chunk_bucket=*/part-*"):
        if "chunk_bucket=" + str(store._bucketed(frame(spark, [("b", "")]), 4).first().chunk_bucket) in str(f):
            f.unlink()
    store.put(frame(spark, second), path, 1, 4)
    assert content(spark, path) == want
    assert store.put(frame(spark, []), path, 2, 4) == [] and content(spark, path) == want


def test_streamed_batches_equal_upserts_one_by_one(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = frame(spark, [])
    for i in range(3):
        rows = frame(spark, [(f"c{j}", f"{i}.{j}") for j in range(i * 5, i * 5 + 12)])
        rows.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        want = store.upserted(want, rows)
        upsert_stream(spark.readStream.schema(SCHEMA).json(str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "state"), 8).awaitTermination()
        assert content(spark, str(tmp_path / "s")) == sorted((r.chunk_id, r.text) for r in want.collect())
    assert read_store(spark, str(tmp_path / "s")).columns == ["chunk_id", "text", "bucket", "batch"]


@pytest.mark.parametrize("lasting", [True, False])
def test_collections(spark, tmp_path, lasting):
    path = str(tmp_path / "kept") if lasting else None
    own = store.ChunkStore(spark, path, 4)
    assert own.read().collect() == []
    assert own.upsert(frame(spark, [("a", "1"), ("b", "1")])) == 2
    assert own.upsert(frame(spark, [("b", "2"), ("c", "2")])) == 3
    assert own.read().where(F.col("chunk_id") == "b").first().text == "2"
    own.clear()
    assert own.read().collect() == [] and own.upsert(frame(spark, [("z", "1")])) == 1
