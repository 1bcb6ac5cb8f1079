"""Dense retrieval by inverted lists: vectors are dealt into cells around learnt centres, and a query meets the cells nearest
to it. Of the cells left out, those that can still hold one of the k best are known by their radius, so a second step makes
the result exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigraph.operators.dense import _matrix
from verdigraph.operators.matched import leading
from verdigraph.operators.sparse import top
from verdigraph.staging import staged

#: The centres are learnt from this many vectors at most, the first by a hash of their keys, in one task.
FIT_ROWS = 16_384
#: Most vectors, and most queries, of one cell that meet in one group; more of them are dealt over several groups.
CELL_ROWS, QUERY_ROWS = 20_000, 4096
#: Most cosines that a task holds at once, and most queries that it deals to their cells at once.
COSINES, PROBED_ROWS = 1 << 20, 512
#: Queries that `probes_for` measures by.
TUNE_ROWS = 256
_ROUNDS = 10


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _vectors(df: DataFrame, key: str, embedding: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).select(key, embedding)


def centres(vectors: DataFrame, key: str, cells: int, embedding: str = "embedding", fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Unit centres (cells, dimension) by spherical k-means over at most fit_rows vectors; fewer vectors give fewer cells."""
    sample = _vectors(vectors, key, embedding).withColumn("order", F.xxhash64(key)).orderBy("order", key).limit(fit_rows)

    def fit(batches):
        parts = [(b.column("order").to_numpy(), _matrix(b.column("vector"))) for b in batches if b.num_rows]
        if not parts:
            return
        x = _unit(np.concatenate([p for _, p in parts])[np.argsort(np.concatenate([o for o, _ in parts]), kind="stable")])
        found = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:cells]].copy()
        for _ in range(_ROUNDS):
            nearest = np.argmax(x @ found.T, axis=1)
            sums = np.zeros_like(found)
            np.add.at(sums, nearest, x)
            met = np.linalg.norm(sums, axis=1) > 0
            found[met] = _unit(sums[met])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found.tolist(), pa.list_(pa.float64()))], names=["cell", "centre"])

    rows = sample.select("order", F.col(embedding).alias("vector")).coalesce(1).mapInArrow(fit, "cell long, centre array<double>").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows])


@dataclass(frozen=True)
class CellIndex:
    """vectors: (key, embedding, cell). radius: the cosine of the farthest vector of each cell from its centre."""

    key: str
    embedding: str
    centres: np.ndarray
    vectors: DataFrame
    radius: np.ndarray


def built(vectors: DataFrame, key: str, cells: int = 64, embedding: str = "embedding", fit_rows: int = FIT_ROWS) -> CellIndex:
    """The index over every vector, null keys and vectors left out; it lies in the shared folder."""
    middle = centres(vectors, key, cells, embedding, fit_rows)
    sent = vectors.sparkSession.sparkContext.broadcast(middle)
    rows = _vectors(vectors, key, embedding)
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("near", T.DoubleType())])

    def assign(batches):
        for batch in batches:
            x = _unit(_matrix(batch.column(1)))
            sims = x @ sent.value.T
            cell = np.argmax(sims, axis=1)
            near = np.where(np.abs(x).sum(axis=1) > 0, sims[np.arange(len(x)), cell], 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near)], names=schema.names)

    dealt = staged(rows.mapInArrow(assign, schema), "cells") if len(middle) else rows.limit(0).withColumns({"cell": F.lit(0), "near": F.lit(1.0)})
    radius = np.ones(len(middle))
    for r in dealt.groupBy("cell").agg(F.min("near").alias("near")).collect():  # a row a cell
        radius[r["cell"]] = min(1.0, r["near"])
    return CellIndex(key, embedding, middle, dealt.drop("near"), radius)


def _probed(index: CellIndex, queries: DataFrame, query_key: str, choose) -> DataFrame:
    """(query_key, cell, vector): each query (query_key, vector, ...) with the cells that choose(batch, cosines) marks."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius))
    schema = T.StructType([queries.schema[query_key], T.StructField("cell", T.IntegerType()), queries.schema["vector"]])

    def probe(batches):
        middle, radius = sent.value
        for whole in batches:
            for first in range(0, whole.num_rows, PROBED_ROWS):  # a vector goes out once for each of its cells
                batch = whole.slice(first, PROBED_ROWS)
                sims = np.clip(_unit(_matrix(batch.column("vector"))) @ middle.T, -1, 1)
                row, cell = np.nonzero(choose(batch, sims, radius))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(query_key).take(at), pa.array(cell.astype(np.int32)), batch.column("vector").take(at)], names=schema.names)

    return queries.mapInArrow(probe, schema)


def _nearest(probes: int):
    def choose(batch, sims, radius):
        marked = np.zeros(sims.shape, bool)
        np.put_along_axis(marked, np.argsort(-sims, axis=1, kind="stable")[:, :probes], True, axis=1)
        return marked

    return choose


def _reachable(probes: int):
    first = _nearest(probes)

    def choose(batch, sims, radius):
        # no vector of a cell is nearer than the angle to its centre less the cell's radius
        bound = np.cos(np.maximum(0.0, np.arccos(sims) - np.arccos(np.clip(radius, -1, 1))))
        least = batch.column("least").fill_null(-1.0).to_numpy()[:, None]
        return (np.maximum(bound, 0.0) >= least - 1e-8) & ~first(batch, sims, radius)

    return choose


def _compared(index: CellIndex, probes: DataFrame, query_key: str, k: int) -> DataFrame:
    """(query_key, key, dense_score): the k nearest of each group of vectors that a query meets."""
    key, cuts = index.key, lambda n, most: F.greatest(F.lit(1), F.ceil(F.coalesce(n, F.lit(0)) / most)).cast("int")
    probes = staged(probes, "probes")
    sizes = index.vectors.groupBy("cell").agg(F.count("*").alias("n")).join(probes.groupBy("cell").agg(F.count("*").alias("asked")), "cell")
    sizes = F.broadcast(sizes.select("cell", cuts(F.col("n"), CELL_ROWS).alias("rows"), cuts(F.col("asked"), QUERY_ROWS).alias("turns")))  # a row a cell
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.vectors.join(sizes, "cell").select("cell", part(key, "rows").alias("row_part"), each("turns").alias("query_part"), F.col(key).alias("__key"), F.col(index.embedding).alias("vector"))
    asked = probes.join(sizes, "cell").select("cell", each("rows").alias("row_part"), part(query_key, "turns").alias("query_part"), F.col(query_key).alias("__query"), "vector")
    schema = T.StructType([T.StructField("__query", asked.schema["__query"].dataType), T.StructField("__key", held.schema["__key"].dataType), T.StructField("dense_score", T.DoubleType())])

    def multiply(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("__key").combine_chunks()
        names, asked_names = left.column("__key"), right.column("__query")
        i, j, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            x = _unit(_matrix(left.column("vector").combine_chunks()))
            step = max(1, COSINES // len(x))
            for first in range(0, right.num_rows, step):  # a matrix of bounded size, however many meet
                q = _unit(_matrix(right.column("vector").slice(first, step).combine_chunks()))
                sims = np.clip(q @ x.T, 0, 1)
                column = leading(np.round(sims, 9), k)  # ties go to the smaller key
                i.append(np.repeat(np.arange(first, first + len(q)), column.shape[1]))
                j.append(column.ravel())
                score.append(np.take_along_axis(sims, column, 1).ravel())
        i, j, score = map(np.concatenate, (i, j, score))
        return pa.table({"__query": asked_names.take(pa.array(i)), "__key": names.take(pa.array(j)), "dense_score": pa.array(score)})

    place = ["cell", "row_part", "query_part"]
    return held.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(multiply, schema)


def near_top(queries: DataFrame, index: CellIndex, query_key: str, k: int, probes: int = 8, exact: bool = False, embedding: str = "embedding") -> DataFrame:
    """(query_key, key, dense_score, rank): the k nearest vectors of the `probes` cells nearest to each query.

    exact adds the cells whose radius leaves room for a vector as near as the k-th found, which gives the k nearest of all.
    Cosines are clamped to 0..1, ties go to the smaller key, zero vectors score 0, null keys and vectors take no part.
    """
    if k <= 0 or probes <= 0:
        raise ValueError("k and probes must be positive")
    asked = queries.where(F.col(query_key).isNotNull() & F.col(embedding).isNotNull()).select(query_key, F.col(embedding).alias("vector"))
    if not len(index.centres):
        return asked.select(query_key, F.lit(None).cast(index.vectors.schema[index.key].dataType).alias(index.key), F.lit(0.0).alias("dense_score"), F.lit(1).alias("rank")).limit(0)
    found = staged(_compared(index, _probed(index, asked, query_key, _nearest(probes)), query_key, k), "near")
    if exact:
        kth = top(found, "__query", "__key", F.round("dense_score", 9), k).where(F.col("rank") == k).select(F.col("__query").alias(query_key), F.col("dense_score").alias("least"))
        more = _probed(index, asked.join(kth, query_key, "left"), query_key, _reachable(probes))
        found = found.unionByName(_compared(index, more, query_key, k))
    out = top(found, "__query", "__key", F.round("dense_score", 9), k)
    return out.select(F.col("__query").alias(query_key), F.col("__key").alias(index.key), "dense_score", "rank")


def probes_for(queries: DataFrame, index: CellIndex, query_key: str, k: int, least: float = 0.95, embedding: str = "embedding", sample: int = TUNE_ROWS) -> int:
    """How many cells near_top must probe for a recall of `least` at k, measured by the exact rows of at most `sample`
    queries (the first by a hash of their keys): the place, in the order of probing, of the cell that holds each of them."""
    asked = queries.where(F.col(query_key).isNotNull() & F.col(embedding).isNotNull()).select(query_key, F.col(embedding).alias("vector"))
    asked = staged(asked.orderBy(F.xxhash64(query_key), query_key).limit(sample), "tuning-queries")
    exact = near_top(asked, index, query_key, k, max(1, len(index.centres) // 4), exact=True, embedding="vector")
    held = exact.join(index.vectors.select(index.key, F.col("cell").alias("own")), index.key).join(asked, query_key).select("own", "vector")
    sent = queries.sparkSession.sparkContext.broadcast(index.centres)

    def place(batches):
        for batch in batches:
            sims = np.clip(_unit(_matrix(batch.column("vector"))) @ sent.value.T, -1, 1)
            order = np.argsort(np.argsort(-sims, axis=1, kind="stable"), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(order[np.arange(len(order)), batch.column("own").to_numpy()] + 1)], names=["place"])

    counts = held.mapInArrow(place, "place long").groupBy("place").count().orderBy("place").collect()  # a row a cell at most
    total, met = sum(r["count"] for r in counts), 0
    for r in counts:
        met += r["count"]
        if met >= least * total:
            return r["place"]
    return 1


def recall(found: DataFrame, exact: DataFrame, query_key: str, key: str) -> float:
    """The share of the exact rows (query_key, key) that were found."""
    met = exact.select(query_key, key).join(found.select(query_key, key, F.lit(1).alias("met")), [query_key, key], "left")
    return met.agg(F.avg(F.coalesce("met", F.lit(0)))).first()[0] or 0.0
