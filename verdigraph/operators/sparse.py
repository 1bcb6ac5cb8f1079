"""BM25 over a batch of queries. Texts are cut into tokens once (`indexed`); statistics are one aggregation over the
staged tokens. The queries' tokens, with their weights, are broadcast while they are few: a document counts its tokens in
its own row, one exchange by document sums the scores, and only the best rows of a task meet those of other tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigraph.functions.rules import SearchRules
from verdigraph.functions.text import let, search_tokens
from verdigraph.staging import spread, staged

#: Most (query, token) rows that are broadcast; more of them meet the documents by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Pairs of a query and a document that one task counts and sorts, about, however many there are in all.
PAIRS = 1_000_000


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    floor: float = 0.25


def tokenized(docs: DataFrame, key: str, text: str = "text", rules: SearchRules = SearchRules()) -> DataFrame:
    """(key, tokens) of rows whose text is not null."""
    return docs.where(F.col(text).isNotNull()).select(key, search_tokens(F.col(text), rules).alias("tokens"))


def indexed(docs: DataFrame, key: str, text: str = "text", rules: SearchRules = SearchRules()) -> DataFrame:
    """`tokenized` rows, written once for all that read them."""
    return staged(tokenized(spread(docs.select(key, text)), key, text, rules), "search-tokens")


def counted(tokens: Column) -> Column:
    """array<struct<token, tf>> of a document's tokens: sorted, each run of equal ones is a token and its length a count."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p).alias("token"), (F.coalesce(F.get(at, j + 1), F.size(s)) - p).alias("tf"))))

    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), runs))  # array_sort would compare by a lambda


def document_frequencies(tokens: DataFrame) -> DataFrame:
    """(token, df); every document sends a token once."""
    return tokens.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def idf(tokens: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
    """(token, df, idf). What would be negative becomes `floor` times the mean over the vocabulary."""
    n = tokens.agg(F.count("*").alias("n"))
    raw = staged(document_frequencies(tokens), "document-frequencies").join(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw") < 0, params.floor * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _met(posted: DataFrame, wanted: DataFrame, n_pairs: int, query_key: str, key: str) -> DataFrame:
    """Postings beside the wanted rows of their token. The rows of a pair are in one task, in as many parts as keep a task's
    pairs near PAIRS at most; only tokens that some query holds travel."""
    parts = max(posted.sparkSession.sparkContext.defaultParallelism, -(-n_pairs // PAIRS))
    if wanted.count() > BROADCAST_ROWS:
        return posted.join(wanted, "token").repartition(parts, query_key, key)
    return posted.join(F.broadcast(wanted.select("token").distinct()), "token", "left_semi").repartition(parts, key).join(F.broadcast(wanted), "token")


def scores(queries: DataFrame, tokens: DataFrame, query_key: str, key: str, params: Bm25 = Bm25(), weights: DataFrame | None = None) -> DataFrame:
    """(query_key, key, bm25) of pairs that share a token; all other pairs score 0. A repeated query token counts again.

    Only tokens that some query holds leave the documents' side, with their counts; the rest of a document is its length.
    """
    weights = idf(tokens, params) if weights is None else weights
    wanted = queries.select(query_key, F.explode("tokens").alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("times"))
    wanted = staged(wanted.join(weights.select("token", "idf"), "token").select(query_key, "token", (F.col("times") * F.col("idf")).alias("weight")), "wanted-tokens")
    length = tokens.agg(F.avg(F.size("tokens")).alias("mean_size"))  # one row
    posted = tokens.select(key, F.size("tokens").alias("doc_size"), F.explode(counted(F.col("tokens"))).alias("x")).select(key, "doc_size", "x.token", "x.tf")
    hits = _met(posted, wanted, queries.count() * tokens.count(), query_key, key).join(F.broadcast(length))
    norm = params.k1 * (1 - params.b + params.b * F.col("doc_size") / F.col("mean_size"))
    return hits.groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("tf") * (params.k1 + 1) / (F.col("tf") + norm)).alias("bm25"))


def top(scored: DataFrame, query_key: str, key: str, by: Column, k: int, rank: str = "rank") -> DataFrame:
    """The k best rows per query, ranked; equal scores are ordered by key."""
    if k <= 0:
        return scored.withColumn(rank, F.lit(1)).limit(0)
    order = Window.partitionBy(query_key).orderBy(F.desc(by), key)
    return scored.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def minmax(scored: DataFrame, query_key: str, n_docs: int | None, score: str, out: str) -> DataFrame:
    """Scores scaled to 0..1 over all documents of each query; a range of at most 1e-6 gives 0.

    Documents without a row score 0, so with n_docs given the bounds include 0 for queries that miss some.
    """
    w = Window.partitionBy(query_key)
    low, high = F.min(score).over(w), F.max(score).over(w)
    if n_docs is not None:
        partial = F.count("*").over(w) < n_docs
        low, high = F.when(partial, F.least(low, F.lit(0.0))).otherwise(low), F.when(partial, F.greatest(high, F.lit(0.0))).otherwise(high)
    return scored.withColumn(out, F.when(high - low > 1e-6, (F.col(score) - low) / (high - low)).otherwise(0.0))


def best_scaled(scored: DataFrame, query_key: str, key: str, n_docs: int, k: int, score: str, out: str) -> DataFrame:
    """The k best rows per query, ranked, with their scores scaled as `minmax` does. The bounds are a row per query, counted
    where the pairs are; of the pairs only the k best of each task travel."""
    bounds = scored.groupBy(query_key).agg(F.min(score).alias("__low"), F.max(score).alias("__high"), F.count("*").alias("__n"))
    best = top(scored, query_key, key, F.round(score, 9), k).join(bounds, query_key)
    some_miss = F.col("__n") < n_docs
    low, high = F.when(some_miss, F.least("__low", F.lit(0.0))).otherwise(F.col("__low")), F.when(some_miss, F.greatest("__high", F.lit(0.0))).otherwise(F.col("__high"))
    return best.withColumn(out, F.when(high - low > 1e-6, (F.col(score) - low) / (high - low)).otherwise(0.0)).drop("__low", "__high", "__n")


def overlap_scores(queries: DataFrame, tokens: DataFrame, query_key: str, key: str) -> DataFrame:
    """(query_key, key, overlap): query tokens, repeats included, that the document holds, over its size plus one. The
    fallback where no BM25 index is at hand; pairs without a common token score 0 and have no row."""
    wanted = queries.select(query_key, F.explode("tokens").alias("token")).groupBy(query_key, "token").agg(F.count("*").alias("times"))
    wanted = staged(wanted, "wanted-tokens")
    held = tokens.select(key, F.size("tokens").alias("doc_size"), F.explode(F.array_distinct("tokens")).alias("token"))
    hits = _met(held, wanted, queries.count() * tokens.count(), query_key, key).groupBy(query_key, key, "doc_size").agg(F.sum("times").alias("matches"))
    return hits.select(query_key, key, (F.col("matches") / (F.col("doc_size") + 1)).alias("overlap"))
