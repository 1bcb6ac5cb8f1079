"""Which questions people ask, who is to answer them, and which document answers them best.

    python -m jobs.question_digest jobs/question_digest.json --source /data/conversations --index /data/index --target /data/digest

Users' messages that differ in case, accents and signs alone are one question. Every question is counted, routed to a
department and looked up in the search index that `jobs.refresh_index` keeps. `questions`, in folders by department,
has all of them; `report` the ones asked most often in each department. Both are written anew by each run, so a run that
failed is simply run again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobs import refresh_index
from jobs.common import log, main, new_folder
from verdigraph.functions.text import catalog_normalized, search_tokens
from verdigraph.operators import routing
from verdigraph.operators.inverted import StoredIndex
from verdigraph.staging import spread, staged

#: Desks by language, for the given tables; an organisation's configuration names its own.
DESKS = {"desk_en": "the and of that with", "desk_de": "der die und ein nicht", "desk_fr": "le les des dans une", "desk_es": "el los una del que"}


@dataclass(frozen=True)
class Config:
    source: str
    index: str
    target: str
    key: str = "doc_id"
    role: str = "user"
    most: int = 20
    buckets: int = 32
    departments: dict = field(default_factory=lambda: dict(DESKS))


def catalogue(departments: dict[str, str]) -> list[dict]:
    """Rows for the router of departments and their keywords, in their order."""
    return [{"ordinal": i, "department_key": k, "keywords": words.split(), "patterns": []} for i, (k, words) in enumerate(departments.items())]


def questions(conversations: DataFrame, role: str) -> DataFrame:
    """(question, text, n_asked, n_conversations, first_conversation): equal questions together. What is left of a text
    that holds no letter or digit is no question. The text is the first of its spellings in order."""
    asked = conversations.where(F.col("role") == role).select("conv_id", "text", catalog_normalized(F.col("text")).alias("question")).where("question <> ''")
    each = asked.groupBy("question", "conv_id").agg(F.count("*").alias("n"), F.min("text").alias("text"))
    return each.groupBy("question").agg(F.min("text").alias("text"), F.sum("n").alias("n_asked"), F.count("conv_id").alias("n_conversations"), F.min("conv_id").alias("first_conversation"))


def run(spark: SparkSession, config: Config) -> DataFrame:
    """Writes questions and report, and returns all questions with their place in the report (null for those not in it)."""
    read = spread(spark.read.parquet(config.source))
    found = staged(questions(read, config.role).withColumn("id", F.monotonically_increasing_id()), "questions")
    routed = routing.routed(found.select("id", "text"), catalogue(config.departments), "id", "text").select("id", "department_key", "match_score")
    best = StoredIndex(spark, config.index, config.key, config.buckets).top(found.select("id", search_tokens(F.col("text")).alias("tokens")), "id", 1)
    rows = found.join(routed, "id").join(best.select("id", F.col(config.key).alias("best_document"), "bm25"), "id", "left").drop("id")
    rows.hint("rebalance", "department_key").write.mode("overwrite").partitionBy("department_key").parquet(f"{config.target}/questions")
    written = spark.read.schema(rows.schema).parquet(f"{config.target}/questions")
    order = Window.partitionBy("department_key").orderBy(F.desc("n_asked"), F.desc("n_conversations"), "question")
    report = written.withColumn("place", F.row_number().over(order)).where(F.col("place") <= config.most)
    report.write.mode("overwrite").partitionBy("department_key").parquet(f"{config.target}/report")
    counts = written.groupBy("department_key").agg(F.count("*").alias("n"), F.sum("n_asked").alias("asked"), F.count("best_document").alias("documented")).collect()  # a row a department
    for r in sorted(counts):
        log.info("%s: %d questions asked %d times, %d with a document", *r)
    log.info("read %s, wrote questions and report to %s", config.source, config.target)
    return written.join(spark.read.schema(report.schema).parquet(f"{config.target}/report").select("department_key", "question", "place"), ["department_key", "question"], "left")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole conversations, twice into one new folder, with an index over all documents."""
    folder = new_folder(spark, "job2")
    refresh_index.run(spark, refresh_index.Config(f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint"))
    config = Config(f"{sf_dir}/conversations.parquet", f"{folder}/index", f"{folder}/digest")
    run(spark, config)
    out = run(spark, config)
    return out.select("department_key", "question", "text", "n_asked", "n_conversations", "first_conversation", "match_score", "best_document", F.round("bm25", 6).alias("bm25"), "place")


if __name__ == "__main__":
    main("Digest of asked questions", Config, run)
