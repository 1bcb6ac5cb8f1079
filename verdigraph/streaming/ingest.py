"""Continuous upserts into a chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from verdigraph.sources.documents import BUCKETS, put, read_store  # noqa: F401


def upsert_stream(chunks: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Upserts what is available of a stream of chunks. A batch that is repeated has its number again and replaces what it
    left behind. Store and checkpoint belong together."""

    def write(batch: DataFrame, number: int) -> None:
        put(batch, path, number, buckets)

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
