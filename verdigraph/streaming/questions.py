"""Streamed questions against a stored index that grows meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigraph.operators.inverted import StoredIndex
from verdigraph.operators.sparse import tokenized


def search_stream(questions: DataFrame, index: StoredIndex, path: str, checkpoint: str, k: int = 5, key: str = "question_id", asked_at: str = "asked_at", delay: str = "1 hour", text: str = "text") -> StreamingQuery:
    """Looks up what is available of a stream of questions (key, asked_at, text), and writes (key, document, bm25, rank).

    A question that comes again within `delay` is answered once; one that comes later than the watermark allows is left
    out, as it might be one of those. Each batch meets the index as it stands then, and writes a folder of its own number,
    so a repeated batch replaces what it left behind.
    """
    once = questions.withWatermark(asked_at, delay).dropDuplicatesWithinWatermark([key])

    def answer(batch: DataFrame, number: int) -> None:
        own = StoredIndex(batch.sparkSession, index.path, index.key, index.buckets, index.rules, index.params)
        found = own.top(tokenized(batch, key, text, index.rules), key, k)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return once.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(index: StoredIndex, path: str) -> DataFrame:
    """All answers that a stream has written."""
    return index.spark.read.parquet(path).drop("batch").withColumn("bm25", F.col("bm25").cast("double"))
