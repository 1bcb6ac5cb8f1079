"""Keeps the search index of a document folder up to date.

    python -m jobs.refresh_index jobs/refresh_index.json --source /data/documents --target /data/index --checkpoint /data/index-state

A file stream reads what is new in the folder since the checkpoint and ends when all of it is indexed. Each batch of it
adds its postings, vocabulary changes and document sizes to the index in folders of its own number, so a batch that
failed half-way replaces what it left behind. A document that comes again replaces its former version; one that comes
without text is removed. Target and checkpoint belong together: whoever deletes one deletes both.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import log, main, new_folder
from verdigraph.operators.inverted import StoredIndex


@dataclass(frozen=True)
class Config:
    source: str
    target: str
    checkpoint: str
    key: str = "doc_id"
    text: str = "text"
    buckets: int = 32
    files_per_batch: int = 1000


def opened(spark: SparkSession, config: Config) -> StoredIndex:
    return StoredIndex(spark, config.target, config.key, config.buckets)


def _stream(spark: SparkSession, config: Config) -> DataFrame | None:
    """The source as a file stream: a folder of Parquet files, or one file. None while there is nothing to read."""
    try:
        kind = spark.read.parquet(config.source).schema
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    wanted = StructType([kind[config.key], kind[config.text]])
    parent, _, name = config.source.rstrip("/").rpartition("/")
    # a stream's path is a folder or a pattern; a pattern that only the source matches serves both
    pattern = f"{parent}/{{{name},{name}}}" if parent else config.source
    return spark.readStream.schema(wanted).option("maxFilesPerTrigger", config.files_per_batch).parquet(pattern)


def run(spark: SparkSession, config: Config) -> DataFrame:
    """Indexes what is new and returns the index as it stands: (token, key, tf, doc_size, df)."""
    index, documents = opened(spark, config), _stream(spark, config)

    def put(batch: DataFrame, number: int) -> None:
        done = StoredIndex(batch.sparkSession, index.path, index.key, index.buckets).add(batch, number, config.text)
        log.info("batch %d from %s: %s", number, config.source, ", ".join(f"{v} {k}" for k, v in done.items()))

    if documents is None:
        log.info("nothing to read in %s", config.source)
    else:
        query = documents.writeStream.foreachBatch(put).option("checkpointLocation", config.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        log.info("read %s up to its end, %d batches; the index is in %s", config.source, len([p for p in query.recentProgress if p["numInputRows"]]), config.target)
    return current(index)


def current(index: StoredIndex) -> DataFrame:
    """The postings of the documents as they stand, with each token's number of documents; no rows before the first batch."""
    if index.live() is None:
        return index.spark.createDataFrame([], f"token string, `{index.key}` string, tf long, doc_size long, df long")
    counts = index.vocabulary().groupBy("token").agg(F.sum("df").alias("df"))
    postings = index.postings().select("token", index.key, F.col("tf").cast("long").alias("tf"), F.col("size").cast("long").alias("doc_size"))
    return postings.join(counts, "token").select("token", index.key, "tf", "doc_size", "df")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole documents, twice into one new folder."""
    folder = new_folder(spark, "job1")
    config = Config(f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    run(spark, config)
    return run(spark, config)


if __name__ == "__main__":
    main("Refresh a search index", Config, run)
