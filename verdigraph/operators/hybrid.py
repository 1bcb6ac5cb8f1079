"""Fusion of dense and sparse candidates, metadata filters, recency, and re-ranking."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdigraph.functions.dates import recency_score
from verdigraph.functions.rules import ACRONYMS, RERANK_SYNONYMS, recency
from verdigraph.functions.text import _listed, expanded, let
from verdigraph.operators.sparse import top
from verdigraph.staging import staged


def candidates(k: int) -> int:
    """How many rows each side passes on for k results."""
    return max(3 * k, 50)


def matches(columns: list[str], wanted: dict, nested: tuple[str, ...] = ("metadata", "doc_meta")) -> Column:
    """Equality on every key; a null column gives way to the maps `nested` in turn. Without keys all rows match."""

    def value(key: str) -> Column:
        found = [F.col(key).cast("string")] if key in columns else []
        found += [F.try_element_at(F.col(m), F.lit(key)) for m in nested if m in columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    return reduce(lambda a, b: a & b, (value(k).eqNullSafe(F.lit(v).cast("string")) for k, v in wanted.items()), F.lit(True))


def fused(dense: DataFrame, sparse: DataFrame, chunks: DataFrame, query_key: str, key: str, alpha: float = 0.5, boost=None, weight=None, k: int | None = None) -> DataFrame:
    """Hits per query: dense (query_key, key, dense_score) and sparse (query_key, key, sparse_score) candidates joined,
    what one side lacks scores 0, keys unknown to chunks go.

    chunks: key and, with recency, `moment`. The recency of a hit lies between the earliest and latest moment among
    its query's candidates. All scores have four decimals, and the rounded score is what is sorted.
    """
    alpha = min(1.0, max(0.0, float(alpha)))
    enabled, w = recency(boost, weight)
    pairs = dense.select(query_key, key, "dense_score").join(sparse.select(query_key, key, "sparse_score"), [query_key, key], "full_outer")
    out = staged(pairs, "candidates").join(chunks, key)  # few candidates are sent to the chunks, which then need no exchange
    d, s = F.coalesce("dense_score", F.lit(0.0)), F.coalesce("sparse_score", F.lit(0.0))
    base = alpha * d + (1 - alpha) * s
    of_query = Window.partitionBy(query_key)
    recent = recency_score(F.col("moment"), F.min("moment").over(of_query), F.max("moment").over(of_query)) if "moment" in chunks.columns else F.lit(0.0)
    out = out.withColumn("__base", base).withColumn("__recent", recent)
    lift = F.col("__recent") * (w if enabled else 0.0)
    names = {"dense_score": d, "sparse_score": s, "raw_hybrid_score": F.col("__base"), "recency_score": F.col("__recent"), "recency_boost": lift, "hybrid_score": F.col("__base") + lift}
    out = out.select(query_key, key, *(c for c in chunks.columns if c not in (key, "moment")), *(F.round(v, 4).alias(n) for n, v in names.items()))
    return out if k is None else top(out, query_key, key, F.col("hybrid_score"), k)


def reciprocal_rank_fusion(hits: DataFrame, query_key: str, key: str, first: str = "dense_score", second: str = "hybrid_score", rrf_k: int = 60, k: int = 5) -> DataFrame:
    """hits with rerank_score, the sum of 1 / (rrf_k + rank) over the rankings by two scores, and final_rank; best k."""
    if rrf_k == -1:
        raise ZeroDivisionError("rrf_k + 1 must not be 0")
    rank = lambda c: F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(c), key))
    out = hits.withColumn("__a", rank(first)).withColumn("__b", rank(second))
    out = out.withColumn("rerank_score", F.round(1 / (F.lit(rrf_k) + F.col("__a")) + 1 / (F.lit(rrf_k) + F.col("__b")), 6)).drop("__a", "__b")
    return top(out, query_key, key, F.col("rerank_score"), k, "final_rank").withColumn("rerank_method", F.lit("rrf"))


def query_words(query: Column) -> Column:
    """Distinct words of a question in lower case, accents kept: longer than two letters or known abbreviations, and what these stand for."""
    raw = F.array_distinct(F.regexp_extract_all(F.lower(query), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    kept = F.filter(raw, lambda w: (F.length(w) > 2) | F.array_contains(_listed(ACRONYMS), w))
    return F.array_distinct(F.concat(kept, expanded(kept, {k: v.split() for k, v in RERANK_SYNONYMS.items()})))


def coverage(words: Column, text: Column) -> Column:
    """The share of words that a text holds as substrings; 0 without words."""
    body = F.lower(F.coalesce(text, F.lit("")))
    found = let(body, lambda b: F.size(F.filter(words, lambda w: F.contains(b, w))))
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.0)


def feature_fusion(hits: DataFrame, query_key: str, key: str, query: str = "query", weights: tuple[float, float, float, float] = (0.45, 0.25, 0.10, 0.20), k: int = 5) -> DataFrame:
    """hits (with query, section_title, file_name, text, hybrid_score) re-ranked by a weighted sum of the hybrid score
    and the query's coverage in title, file name and text."""
    out = hits.withColumn("__words", query_words(F.col(query)))
    parts = [coverage(F.col("__words"), F.col(c)) for c in ("section_title", "file_name", "text")]
    score = F.coalesce("hybrid_score", F.lit(0.0)) * weights[0] + parts[0] * weights[1] + parts[1] * weights[2] + parts[2] * weights[3]
    out = out.withColumn("rerank_score", F.round(score, 4)).drop("__words")
    return top(out, query_key, key, F.col("rerank_score"), k, "final_rank").withColumn("rerank_method", F.lit("feature_fusion"))


def cross_encoded(hits: DataFrame, query_key: str, key: str, model=None, query: str = "query", k: int = 5) -> DataFrame:
    """hits re-ranked by the sigmoid of a model's scores; model: a function from (queries, texts) to numbers. Without one, feature fusion."""
    if model is None:
        return feature_fusion(hits, query_key, key, query, k=k)
    schema = T.StructType([*hits.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            raw = model(batch.column(query).to_pylist(), batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(x) for x in raw])], names=[f.name for f in schema.fields])

    out = hits.mapInArrow(run, schema).withColumn("rerank_score", F.round(1 / (1 + F.exp(-F.col("rerank_score"))), 4))
    return top(out, query_key, key, F.col("rerank_score"), k, "final_rank").withColumn("rerank_method", F.lit("cross_encoder"))


def adaptive_sources(hits: DataFrame, query_key: str, most: int = 8) -> DataFrame:
    """(query_key, sources): which re-ranked hits an answer builds on, in rank order.

    Taken are the first two from 0.15 on, hits near the top score (0.7 of it, 0.22 at least), and hits of documents
    not yet taken (0.55 of it, 0.28 at least), up to `most`; if none qualifies, the first two. Whether a document was
    taken depends on the order, so the rows of a query, which re-ranking has limited, are folded in that order.
    """
    fields = [c for c in hits.columns if c not in (query_key, "final_rank")]
    ranked = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct("final_rank", *fields))).alias("hits"))
    top_score = F.col("hits")[0]["rerank_score"]
    kind = ranked.schema["hits"].dataType.simpleString()

    def step(a: Column, h: Column) -> Column:
        score = h["rerank_score"]
        early = (h["final_rank"] <= 2) & (score >= 0.15)
        near = (score >= top_score * 0.7) & (score >= 0.22)
        other = ~F.exists(a, lambda x: x["file_name"].eqNullSafe(h["file_name"])) & (score >= 0.28) & (score >= top_score * 0.55)
        return F.when((F.size(a) < most) & (early | near | other), F.concat(a, F.array(h))).otherwise(a)

    chosen = F.aggregate("hits", F.array().cast(kind), step)
    return ranked.withColumn("chosen", chosen).select(query_key, F.when(F.size("chosen") > 0, F.col("chosen")).otherwise(F.slice("hits", 1, 2)).alias("sources"))
