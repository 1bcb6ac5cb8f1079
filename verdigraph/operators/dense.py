"""Exact dense retrieval for a batch of queries, and the hashed-token embedding."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.operators.matched import DOCUMENTS, Best
from verdigraph.operators.sparse import top

#: Most queries that one pass over the vectors carries along.
BLOCK = 1024
#: Texts that share the vectors of their tokens while they are hashed.
GROUP = 2048


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, from its values buffer; nulls inside a vector are 0."""
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def cosine_top(queries: DataFrame, vectors: DataFrame, query_key: str, key: str, k: int, embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_key, key, dense_score, rank): the k nearest vectors per query by cosine, clamped to 0..1; zero vectors score 0.

    Queries go along in blocks of bounded size; each task multiplies its vectors with a block and passes its own k
    best per query on, so the shuffle holds k rows per query and task. Null keys and vectors take no part.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    asked = queries.where(F.col(query_key).isNotNull() & F.col(embedding).isNotNull()).select(query_key, embedding)
    n = asked.count()
    blocks = max(1, -(-n // block))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64(query_key), F.lit(blocks)))
    rows = vectors.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(key, embedding)
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField("__key", vectors.schema[key].dataType), T.StructField("dense_score", T.DoubleType())])
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string() for f in schema.fields[:2]]
    found = None
    for b in range(blocks):
        part = numbered.where(F.col("block") == b).toArrow()
        ids = part.column(query_key).to_pylist()
        q = _matrix(part.column(embedding).combine_chunks()) if len(ids) else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300) if len(ids) else q))

        def run(batches, sent=sent):
            ids, q = sent.value
            best = Best(len(ids), k)
            for batch in batches if ids else ():
                for start in range(0, batch.num_rows, DOCUMENTS):  # a matrix of bounded size, however large a batch is
                    part = batch.slice(start, DOCUMENTS)
                    own = part.column(0).to_numpy(zero_copy_only=False)
                    order = np.argsort(own, kind="stable")  # ties go to the smaller key
                    x = _matrix(part.column(1))[order]
                    norm = np.linalg.norm(x, axis=1, keepdims=True)
                    best.add(np.clip(q @ np.divide(x, norm, out=np.zeros_like(x), where=norm > 0).T, 0, 1), own[order])
            if best.key is not None:
                i, j = np.nonzero(np.isfinite(best.score))
                yield pa.RecordBatch.from_arrays([pa.array([ids[a] for a in i], kinds[0]), pa.array(best.key[i, j], kinds[1]), pa.array(best.score[i, j])], names=schema.names)

        made = rows.mapInArrow(run, schema)
        found = made if found is None else found.unionByName(made)
    return top(found.withColumnRenamed("__key", key) if key != query_key else found, query_key, key if key != query_key else "__key", F.round("dense_score", 9), k)


def _seed(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest(), 16) % (1 << 32)


def hash_embeddings(texts: list[str | None], dim: int = 768) -> np.ndarray:
    """For each text the mean of one pseudo-random normal vector per token, seeded by the token's md5, scaled to length 1. A
    text without tokens has the vector of its lower case as a whole.

    A vector is drawn once for all texts, and they add vectors in the order of the seeds, so the other texts change nothing.
    One generator is seeded again and again: making one costs ten times what it draws.
    """
    seeds: dict[str, int] = {}
    total, sizes = np.zeros((len(texts), dim)), np.ones(len(texts))
    pairs, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, text in enumerate(texts):
        clean = (text or "").lower().strip()
        counts = Counter(clean.split() or [clean])
        own = [seeds[t] if t in seeds else seeds.setdefault(t, _seed(t)) for t in counts]
        pairs.append((np.array(own, np.uint64) << np.uint64(32)) | np.uint64(i))
        times.append(np.fromiter(counts.values(), np.int64, len(counts)))
        sizes[i] = counts.total()
    pairs, inverse = np.unique(np.concatenate(pairs), return_inverse=True)
    times = np.bincount(inverse, np.concatenate(times), len(pairs))
    seed, row = pairs >> np.uint64(32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edges = [*np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]]).tolist(), len(seed)] if len(seed) else [0]
    drawn = np.random.RandomState()
    for a, b in zip(edges, edges[1:], strict=False):
        drawn.seed(int(seed[a]))
        vector = drawn.randn(dim)
        if b - a < 8:
            for r, n in zip(row[a:b].tolist(), times[a:b].tolist(), strict=True):
                total[r] += vector if n == 1 else n * vector
        else:
            total[row[a:b]] += times[a:b, None] * vector
    total /= sizes[:, None]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return np.divide(total, norm, out=total, where=norm > 0)


def hash_embedding(text: str | None, dim: int = 768) -> np.ndarray:
    """`hash_embeddings` of one text."""
    return hash_embeddings([text], dim)[0]


def embedded(docs: DataFrame, key: str, text: str = "text", dim: int = 768, embed=None, batch_size: int = 32) -> DataFrame:
    """(key, embedding array<float>) of every row. embed: other functions from a list of texts to vectors, one or a list
    of them. They get batch_size texts at a time; the first that gives as many vectors as texts serves and is asked
    first from then on; a batch that all fail on falls back to the hashed embedding."""
    models = [] if embed is None else list(embed) if isinstance(embed, list | tuple) else [embed]

    def run(batches):
        order = list(models)

        def made(texts: list) -> list[np.ndarray]:
            for model in order:
                try:
                    out = [np.asarray(v, np.float32) for v in model(texts)]
                except Exception:  # an external model may fail in any way
                    continue
                if len(out) == len(texts):
                    order.remove(model)
                    order.insert(0, model)
                    return out
            return list(hash_embeddings(texts, dim).astype(np.float32))

        step = batch_size if models else GROUP
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                group = batch.slice(start, GROUP)
                texts = group.column(1).to_pylist()
                out = [v for at in range(0, len(texts), step) for v in made(texts[at : at + step])]
                ends = np.cumsum([0, *map(len, out)], dtype=np.int32)
                vectors = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.float32), *out])))
                yield pa.RecordBatch.from_arrays([group.column(0), vectors], names=[key, "embedding"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, embedding array<float>")
