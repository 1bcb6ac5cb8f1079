"""Sources and sinks: page texts, chunk files and the chunk store."""

from __future__ import annotations

import shutil
import subprocess
import uuid
from collections.abc import Callable
from pathlib import PurePath

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigraph.functions.text import strip
from verdigraph.staging import shared_dir

CHUNK_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("chunk_id", "file_name", "file_path", "category", "department_author", "last_updated", "section_title")]
    + [T.StructField(n, T.IntegerType()) for n in ("page_start", "page_end", "char_count", "word_count")]
    + [T.StructField("text", T.StringType())]
)

#: Folders of a store; a batch rewrites those that it has chunks of.
BUCKETS = 64


def extractor_installed(tool: str = "pdftotext") -> bool:
    return shutil.which(tool) is not None


def pdftotext(content: bytes) -> str:
    """The text of a PDF by the external tool, pages separated by form feeds."""
    done = subprocess.run(["pdftotext", "-enc", "UTF-8", "-", "-"], input=content, capture_output=True, check=True)
    return done.stdout.decode("utf-8")


def read_pdfs(spark: SparkSession, folder: str, extract: Callable[[bytes], str] = pdftotext) -> DataFrame:
    """(file_name, file_path, raw) of every *.pdf in a folder; a failing extraction fails the job. A missing folder has no files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "file_name string, file_path string, raw string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content")

    def run(batches):
        for batch in batches:
            raw = [extract(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(raw, pa.string())], names=["file_path", "raw"])

    out = files.mapInArrow(run, "file_path string, raw string")
    return out.select(F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "file_path", "raw")


def pages(files: DataFrame, text: str = "raw") -> DataFrame:
    """One row a page of `text`, cut at form feeds; page_num keeps its place, blank pages have no row."""
    out = files.select(*(c for c in files.columns if c != text), F.posexplode(F.split(text, "\f")).alias("page_num", "text"))
    return out.withColumn("page_num", F.col("page_num") + 1).where(strip(F.col("text")) != "")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from a JSON array file; a missing file and broken JSON raise."""
    return spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines, written in parallel."""
    chunks.write.mode("overwrite").json(path)


def write_chunk_array(chunks: DataFrame, path: str) -> None:
    """One JSON array in one file: a chunk a line, in order of chunk_id. It is meant for small corpora."""
    row = F.to_json(F.struct(*chunks.columns))
    last = chunks.agg(F.max("chunk_id").alias("last"))
    lines = chunks.select("chunk_id", row.alias("line")).join(F.broadcast(last)).select("chunk_id", F.when(F.col("chunk_id") == F.col("last"), F.col("line")).otherwise(F.concat("line", F.lit(","))).alias("value"))
    edge = chunks.sparkSession.createDataFrame([(0, "", "["), (2, "", "]")], "part int, chunk_id string, value string")
    whole = lines.select(F.lit(1).alias("part"), "chunk_id", "value").unionByName(edge)
    whole.coalesce(1).sortWithinPartitions("part", "chunk_id").select("value").write.mode("overwrite").text(path)


def indexable(chunks: DataFrame) -> DataFrame:
    """Rows with both chunk_id and text; of rows with one chunk_id one stays, the greatest text."""
    whole = chunks.where("chunk_id is not null and text is not null")
    latest = Window.partitionBy("chunk_id").orderBy(F.desc("text"))
    return whole.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def upserted(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """The store with chunks added, or put in the place of rows with their chunk_id."""
    new = indexable(chunks)
    return store.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new)


def batch_size(value: int) -> int:
    """Zero raises; negative sizes mean that nothing is indexed (0)."""
    if value == 0:
        raise ValueError("batch_size must not be 0")
    return max(0, value)


def chunk_input(spark: SparkSession, given=None, size: int = 100) -> DataFrame:
    """Chunks from whatever a caller passes: a DataFrame, the path of a JSON array, or a list of dicts. Anything empty,
    and any other kind, is no chunks; so is a negative size. A missing file and broken JSON raise, and so does size 0."""
    none = spark.createDataFrame([], CHUNK_SCHEMA)
    if batch_size(size) == 0:
        return none
    if isinstance(given, DataFrame):
        return given
    if isinstance(given, str | PurePath) and str(given).strip():
        return indexable(read_chunks(spark, str(given).strip()))
    if not isinstance(given, list):
        return none
    names = CHUNK_SCHEMA.fieldNames()
    rows = [tuple(c.get(n) for n in names) for c in given if isinstance(c, dict)]
    return indexable(spark.createDataFrame(rows, CHUNK_SCHEMA)) if rows else none


def _bucketed(chunks: DataFrame, buckets: int) -> DataFrame:
    return indexable(chunks).withColumn("chunk_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int"))


def put(chunks: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> list[int]:
    """Upserts a batch of chunks into the store in a folder, and returns the buckets that it touched.

    `changes` keeps the rows of every batch, `store` the newest row of every chunk_id, both in folders by a hash of the
    chunk_id. Only the store's touched buckets are written anew, from the changes to them, so what a batch writes follows
    what is in it. Nothing that is read is overwritten: a batch that failed anywhere is put again, under its number, and
    leaves what one attempt leaves. Batches are numbered upwards.
    """
    new, spark = _bucketed(chunks, buckets), chunks.sparkSession
    folder = f"{path}/changes/change_batch={batch}"
    new.hint("rebalance", "chunk_bucket").write.mode("overwrite").partitionBy("chunk_bucket").parquet(folder)
    touched = sorted(r[0] for r in spark.read.schema(new.schema).parquet(folder).select("chunk_bucket").distinct().collect())  # at most `buckets`
    if touched:
        kind = T.StructType([*new.schema.fields, T.StructField("change_batch", T.LongType())])
        known = spark.read.schema(kind).parquet(f"{path}/changes").where(F.col("chunk_bucket").isin(touched) & (F.col("change_batch") <= batch))
        latest = Window.partitionBy("chunk_id").orderBy(F.desc("change_batch"))
        current = known.withColumn("__n", F.row_number().over(latest)).where("__n = 1").select(*new.columns)
        current.hint("rebalance", "chunk_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_bucket").parquet(f"{path}/store")
    return touched


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The chunks of a store as they stand; None before the first one."""
    try:
        return spark.read.parquet(f"{path}/store").drop("chunk_bucket")
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


class ChunkStore:
    """A chunk collection: a store in a folder, or, without a path (or with ":memory:"), one that ends with the
    application, in the shared folder of the session. A plan that reads it sees the buckets as they are when it runs."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> None:
        self.spark, self.buckets = spark, buckets
        lasting = bool(path) and path != ":memory:"
        self.path = path if lasting else f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/collection-{uuid.uuid4().hex}"

    def read(self) -> DataFrame:
        found = read_store(self.spark, self.path)
        return self.spark.createDataFrame([], CHUNK_SCHEMA) if found is None else found

    def upsert(self, chunks: DataFrame) -> int:
        """How many chunks the collection has afterwards."""
        try:
            last = self.spark.read.parquet(f"{self.path}/changes").agg(F.max("change_batch")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            last = None
        put(chunks, self.path, 0 if last is None else last + 1, self.buckets)
        return self.read().count()

    def clear(self) -> None:
        """Removes all chunks, also for whoever is reading them; the collection can be used again."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def audited(chunks: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """(pattern, n_matches, n_chunks) for each named expression: how often it stands in the corpus, and in how many chunks."""
    counts = [F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(v)).cast("long") for v in patterns.values()]
    rows = chunks.select(F.explode(F.array(*(F.struct(F.lit(k).alias("pattern"), c.alias("n")) for k, c in zip(patterns, counts, strict=True)))).alias("x"))
    found = rows.select("x.pattern", "x.n")
    return found.groupBy("pattern").agg(F.sum("n").alias("n_matches"), F.sum((F.col("n") > 0).cast("long")).alias("n_chunks"))
