from pyspark.sql import functions as F

from verdigraph.operators import sparse
from verdigraph.operators.inverted import StoredIndex
from verdigraph.streaming.questions import answers, search_stream

TABLES = "/root/testdata/sf0.001"


def rows(df):
    return sorted((r.question_id, r["rank"], r.doc_id, round(r.bm25, 7)) for r in df.collect())


def test_streamed_questions_equal_the_batch(spark, tmp_path):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    index = StoredIndex(spark, str(tmp_path / "index"), buckets=4)
    index.add(docs, 0)
    asked = spark.read.parquet(f"{TABLES}/conversations.parquet").where("role = 'user'")
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("turn") * 60)
    asked = asked.select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), start.alias("asked_at"), "text")
    late = spark.createDataFrame([(-1, "the and of")], "question_id long, text string").select("question_id", F.timestamp_seconds(F.lit(1_600_000_000)).alias("asked_at"), "text")
    drops = [asked.where("question_id % 3 <> 0"), asked.where("question_id % 2 = 0"), asked.unionByName(late)]  # many come twice or three times
    (tmp_path / "in").mkdir()
    for rows_in in drops:
        rows_in.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
        search_stream(stream, index, str(tmp_path / "out"), str(tmp_path / "state"), 5).awaitTermination()
    want = rows(index.top(sparse.tokenized(asked, "question_id"), "question_id", 5))
    assert rows(answers(index, str(tmp_path / "out"))) == want and len(want) > 50


def test_the_index_grows_between_batches(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "index"), buckets=4)
    schema = "question_id long, asked_at timestamp, text string"
    (tmp_path / "in").mkdir()
    for i in range(2):
        index.add(spark.createDataFrame([(i, f"zebra documento {i}")], "doc_id long, text string"), i)
        spark.createDataFrame([(i, "zebra")], "question_id long, text string").select("question_id", F.timestamp_seconds(F.lit(1_700_000_000 + i)).alias("asked_at"), "text").write.mode("append").parquet(str(tmp_path / "in"))
        search_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), index, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = answers(index, str(tmp_path / "out")).groupBy("question_id").count().collect()
    assert sorted(map(tuple, found)) == [(0, 1), (1, 2)]
