"""A stored BM25 index that grows by batches, and top-k search that leaves out what can't be among the best.

A folder holds three tables in Parquet. `documents`: each document of a batch with its size. `postings`: token,
document, count, in folders by batch and by a hash of the token. `vocabulary`: per batch, what it adds to each token's
number of documents, and the greatest count and least size of the token's postings in each block. A block holds the
documents of about one size, and of these the postings of about one impact.
A document's newest batch counts; one without text is removed. Batches only add folders of their own, so a batch that is
written again replaces itself, and document numbers follow changes without reading the other documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigraph.functions.rules import SearchRules
from verdigraph.functions.text import search_tokens
from verdigraph.operators import matched
from verdigraph.operators.sparse import BROADCAST_ROWS, Bm25, counted, top
from verdigraph.staging import spread, staged

#: Blocks of impact, and how many times larger the documents of the next block of sizes are.
LEVELS, TIMES = 8, 4
#: Postings of a question that set the score to beat, as a multiple of k.
SEEDS = 40
#: Questions up to which blocks are judged one by one.
FEW = 64
#: Scores that differ by less than this are equal.
_SLACK = 1e-8


def _sent(df: DataFrame) -> DataFrame:
    """Few rows are broadcast, more of them joined by a shuffle."""
    df = staged(df, "index-sent")
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class StoredIndex:
    spark: SparkSession
    path: str
    key: str = "doc_id"
    buckets: int = 32
    rules: SearchRules = field(default_factory=SearchRules)
    params: Bm25 = field(default_factory=Bm25)

    def _table(self, name: str, before: int | None = None) -> DataFrame | None:
        """A table of all batches, or of those before one; None while it has none."""
        try:
            found = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        return found if before is None else found.where(F.col("batch") < before)

    def impact(self, tf: Column, size: Column, mean: float) -> Column:
        p = self.params
        return tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * size / F.lit(mean)))

    def bucket(self, token: Column) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, batch: int, text: str = "text") -> dict[str, int]:
        """Writes documents as a batch and returns what was done. Rows without a key are left out; of rows with one key
        the greatest text counts. Batches are numbered upwards; an existing number is replaced and must be the last one."""
        docs = docs.where(F.col(self.key).isNotNull()).select(self.key, text)
        if not docs.groupBy(self.key).count().where("count > 1").isEmpty():
            docs = docs.groupBy(self.key).agg(F.max(text).alias(text))
        docs = spread(docs)
        tokens = staged(docs.select(self.key, search_tokens(F.col(text), self.rules).alias("tokens")), "index-tokens")  # null for null
        sizes = tokens.select(self.key, F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("size"))
        mean = sizes.agg(F.avg("size")).first()[0] or 1.0
        # a document counts its tokens in its own row, so postings travel once, to their bucket
        posts = tokens.where("tokens is not null").select(self.key, F.size("tokens").alias("size"), F.explode(counted(F.col("tokens"))).alias("x"))
        posts = posts.select(self.key, "size", "x.token", F.col("x.tf").cast("int").alias("tf"))
        level = F.least(F.lit(LEVELS - 1), F.floor(self.impact(F.col("tf"), F.col("size"), mean) * LEVELS / (self.params.k1 + 1))).cast("int")
        posts = posts.select("token", self.key, "size", "tf", F.floor(F.log(float(TIMES), "size")).cast("int").alias("length"), level.alias("level"), self.bucket(F.col("token")).alias("bucket"))
        posts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/batch={batch}")
        own = self.spark.read.schema(posts.schema).parquet(f"{self.path}/postings/batch={batch}")
        change = own.groupBy("token", "length", "level").agg(F.count("*").alias("df"), F.max("tf").alias("most"), F.min("size").alias("least"))
        replaced = self._replaced(sizes, batch)
        if replaced is not None:
            lost = self._table("postings", batch).join(replaced, [self.key, "batch"], "left_semi").groupBy("token", "length", "level").agg((-F.count("*")).alias("df"))
            change = change.unionByName(lost, allowMissingColumns=True)
        change.write.mode("overwrite").parquet(f"{self.path}/vocabulary/batch={batch}")
        sizes.write.mode("overwrite").parquet(f"{self.path}/documents/batch={batch}")  # last: what it lists can be found
        done = sizes.agg(F.count("*").alias("documents"), F.count_if(F.col("size").isNull()).alias("removed")).first().asDict()
        return done | {"replaced": 0 if replaced is None else replaced.count(), "postings": own.count()}

    def _replaced(self, sizes: DataFrame, batch: int) -> DataFrame | None:
        """(key, batch) of the earlier versions of documents; None if there are none."""
        known = self.live(batch)
        if known is None:
            return None
        found = staged(known.where("size is not null").join(sizes.select(self.key), self.key, "left_semi").select(self.key, "batch"), "index-replaced")
        return None if found.isEmpty() else found

    def live(self, before: int | None = None) -> DataFrame | None:
        """(key, batch, size) of the newest version of every document; size is null for removed ones."""
        found = self._table("documents", before)
        return None if found is None else found.groupBy(self.key).agg(F.max("batch").alias("batch"), F.max_by("size", "batch").alias("size"))

    def postings(self) -> DataFrame:
        """(token, key, size, tf, length, level, bucket) of the documents as they stand."""
        found, newest = self._table("postings"), self.live()
        if newest is None:
            raise FileNotFoundError(f"no index in {self.path}")
        if found is None:  # batches without a posting
            return newest.limit(0).select(F.lit("").alias("token"), self.key, "size", *(F.lit(0).alias(c) for c in ("tf", "length", "level", "bucket")))
        current = newest.where("size is not null")
        if self._table("documents").count() > current.count():
            found = found.join(current.select(self.key, "batch"), [self.key, "batch"], "left_semi")
        return found.select("token", self.key, "size", "tf", "length", "level", "bucket")

    def vocabulary(self) -> DataFrame:
        """(token, length, level, df, most, least) over all batches. Bounds of postings that are gone may still be counted in."""
        merged = self._table("vocabulary").groupBy("token", "length", "level").agg(F.sum("df").alias("df"), F.max("most").alias("most"), F.min("least").alias("least"))
        return merged.where("df > 0")

    def statistics(self) -> tuple[int, float]:
        """How many documents there are, and their mean size."""
        n, mean = self.live().where("size is not null").agg(F.count("*"), F.avg("size")).first()
        return n, mean or 1.0

    def weights(self, vocabulary: DataFrame, n: int) -> DataFrame:
        """(token, df, idf); what would be negative becomes `floor` times the mean over the vocabulary."""
        raw = vocabulary.groupBy("token").agg(F.sum("df").alias("df")).withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("raw").alias("mean"))  # one row
        return raw.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, self.params.floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))

    def candidates(self, asked: DataFrame, query_key: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame, float]:
        """(query_key, key, got) pairs that hold every question's k best documents; with them the blocks that `got` leaves
        out, the postings, and the mean size.

        The k-th best score of a few documents from blocks of high bounds is one that k documents reach. Then each length of
        documents is judged for itself: tokens that can't reach that score together, in order of their bounds, bring no
        candidates; of the other tokens a block is left out if its bound and all other tokens' bounds stay below. A candidate
        goes if what it has and what it may still have do.
        """
        n, mean = self.statistics()
        vocabulary = staged(self.vocabulary(), "index-vocabulary")
        wanted = asked.select(query_key, F.explode("tokens").alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("times"))
        wanted = staged(wanted.join(self.weights(vocabulary, n), "token").select(query_key, "token", (F.col("times") * F.col("idf")).alias("weight")), "index-wanted")
        bound = F.greatest(F.lit(0.0), F.col("weight") * self.impact(F.col("most"), F.col("least"), mean))
        blocks = staged(wanted.join(vocabulary, "token").select(query_key, "token", "weight", "length", "level", "df", bound.alias("bound")), "index-blocks")
        gain = F.col("weight") * self.impact(F.col("tf"), F.col("size"), mean)
        buckets = [r[0] for r in wanted.select(self.bucket(F.col("token")).alias("b")).distinct().collect()]  # at most `buckets`
        postings = self.postings().where(F.col("bucket").isin(buckets))
        place = ["token", "length", "level"]

        of_length = Window.partitionBy(query_key, "length")
        first = Window.partitionBy(query_key).orderBy(F.desc(F.col("bound") * F.col("reach")), *place).rowsBetween(Window.unboundedPreceding, -1)
        seeds = blocks.withColumn("reach", F.sum("bound").over(of_length)).withColumn("before", F.coalesce(F.sum("df").over(first), F.lit(0))).where(F.col("before") < SEEDS * k)
        partial = postings.join(_sent(seeds.select(query_key, *place, "weight")), place).groupBy(query_key, self.key).agg(F.sum(gain).alias("got"))
        tried = staged(top(partial, query_key, self.key, F.col("got"), SEEDS * k).select(query_key, self.key), "index-seeds")
        whole = self._scored(tried, wanted, postings, mean, query_key)
        beaten = top(whole, query_key, self.key, F.col("bm25"), k).where(F.col("rank") == k).select(query_key, (F.col("bm25") - _SLACK).alias("beat"))

        upward = of_length.orderBy("ceiling", "token")
        tokens = blocks.groupBy(query_key, "length", "token").agg(F.max("bound").alias("ceiling")).join(beaten, query_key, "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf"))))
        tokens = tokens.withColumn("essential", F.sum("ceiling").over(upward) >= F.col("beat")).withColumn("others", F.sum("ceiling").over(of_length) - F.col("ceiling"))
        judged = blocks.join(tokens.select(query_key, "length", "token", "essential", "others", "beat"), [query_key, "length", "token"])
        judged = judged.withColumn("kept", F.col("essential") & (F.col("bound") + F.col("others") >= F.col("beat")))
        unseen = F.max(F.when(~F.col("kept"), F.col("bound")).otherwise(0.0)).over(Window.partitionBy(query_key, "length", "token"))
        judged = staged(judged.withColumn("unseen", unseen), "index-judged")  # what a token may add to a candidate without a kept posting of it
        limits = judged.groupBy(query_key, "length", "token").agg(F.first("unseen").alias("unseen"), F.first("beat").alias("beat"))
        limits = limits.groupBy(query_key, "length").agg(F.sum("unseen").alias("all_unseen"), F.first("beat").alias("beat"))
        # a token of which every block is kept is one row of its question, whatever the number of its blocks
        every = judged.withColumn("every", F.min(F.col("kept").cast("int")).over(Window.partitionBy(query_key, "token")) == 1).where("kept")
        entire = _sent(every.where("every").select(query_key, "token", "weight").distinct())
        some = _sent(every.where("not every").select(query_key, *place, "weight", "unseen"))
        columns = [query_key, self.key, "length", "tf", "size", "weight", "unseen"]
        hits = postings.join(entire, "token").withColumn("unseen", F.lit(0.0)).select(*columns).unionByName(postings.join(some, place).select(*columns))
        hits = hits.groupBy(query_key, self.key, "length").agg(F.sum(gain).alias("got"), F.sum("unseen").alias("seen")).join(_sent(limits), [query_key, "length"])
        left = hits.where(F.col("got") + F.col("all_unseen") - F.col("seen") >= F.col("beat")).select(query_key, self.key, "got")
        return staged(left, "index-candidates"), judged.where("not kept").select(query_key, *place, "weight"), postings, mean

    def top(self, asked: DataFrame, query_key: str, k: int) -> DataFrame:
        """(query_key, key, bm25, rank): the k best documents of every question (query_key, tokens), by whole scores.
        Documents without a token of the question have no row. Few questions read what can matter to them; to many
        nearly all does, so they are scored against all documents together."""
        if k > 0 and asked.count() > FEW:
            return self.matched(asked, query_key, k)
        left, others, postings, mean = self.candidates(asked, query_key, k)
        pair, place = [query_key, self.key], ["token", "length", "level"]
        rest = postings.join(left.select(self.key).distinct(), self.key, "left_semi").join(_sent(others), place).join(left.select(*pair), pair, "left_semi")
        rest = rest.groupBy(*pair).agg(F.sum(F.col("weight") * self.impact(F.col("tf"), F.col("size"), mean)).alias("rest"))
        whole = left.join(rest, pair, "left").select(*pair, (F.col("got") + F.coalesce("rest", F.lit(0.0))).alias("bm25"))
        return top(whole, query_key, self.key, F.round("bm25", 9), k)

    def matched(self, asked: DataFrame, query_key: str, k: int) -> DataFrame:
        """What `top` returns, from every posting of the questions' tokens, which meet in their document once."""
        n, mean = self.statistics()
        wanted = asked.select(query_key, F.explode("tokens").alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("times"))
        weights = self.weights(staged(self.vocabulary(), "index-vocabulary"), n)
        wanted = staged(wanted.join(weights, "token").select(query_key, "token", (F.col("times") * F.col("idf")).alias("weight")), "index-wanted")
        tokens = _sent(wanted.select("token").distinct().withColumn("t", F.monotonically_increasing_id()))  # written, so numbers stay
        posts = self.postings().join(tokens, "token").select(self.key, "t", self.impact(F.col("tf"), F.col("size"), mean).cast("double").alias("gain"))
        docs = posts.groupBy(self.key).agg(F.collect_list("t").alias("t"), F.collect_list("gain").alias("gain"))
        numbered = staged(wanted.join(tokens, "token").select(query_key, "t", "weight"), "index-numbered")
        return matched.best(numbered, docs, query_key, self.key, k)

    def _scored(self, pairs: DataFrame, wanted: DataFrame, postings: DataFrame, mean: float, query_key: str) -> DataFrame:
        """(query_key, key, bm25) of the pairs (query_key, key)."""
        rows = postings.join(pairs.select(self.key).distinct(), self.key, "left_semi").join(_sent(wanted), "token").join(pairs, [query_key, self.key], "left_semi")
        return rows.groupBy(query_key, self.key).agg(F.sum(F.col("weight") * self.impact(F.col("tf"), F.col("size"), mean)).alias("bm25"))
