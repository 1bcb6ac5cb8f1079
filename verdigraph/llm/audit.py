"""How filters of documents interact: what each of them removes under every order in which they may run.

A document is a set of failed filters, five bits. For each of the 32 sets and the 120 orders a table holds the step at
which the document goes. Tasks look their documents up in it, count with `np.bincount` by part, order and step, and
pass on one array of counts a part; the arrays are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: FIRST[failed, order]: the step (from 0) whose filter removes the document; STEPS if none does.
FIRST = np.array([[next((s for s, f in enumerate(order) if failed >> FILTERS.index(f) & 1), STEPS) for order in ORDERS] for failed in range(1 << STEPS)])
#: LETTER[order, step]: the filter that runs there.
LETTER = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: Parts that a task counts together.
MOST_PARTS = 256
_LOOKED_UP = 8192
_WORDS = r"[^\x20\x09-\x0D]+"
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failed(text: Column, least_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5) -> Column:
    """Bits 1 to 8 of the filters A to D that a text fails; null counts as empty.

    A: few words. B: too few of them are different. C: too many capitals. D: a symbol of #$%&*|. An empty text fails A.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))
    conditions = [
        F.size(words) < least_words,
        F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(distinct_percent),
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * capital_percent,
        text.rlike("[#$%&*|]"),
    ]
    return sum((c.cast("int") * (1 << i) for i, c in enumerate(conditions)), F.lit(0))


def tallies(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, good, toxic, n): how many documents of a part fail exactly these filters.

    E is failed by a row whose text another row with a smaller doc_id has; a row without doc_id neither fails it nor
    makes others fail. A document is good or toxic if any of its label rows says so. Texts travel as digests, and copies
    are counted before they meet: a digest's rows are at most its parts times the sets of labels.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), failed(F.col("text")).alias("failed"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"))
    marks = labels.groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1).cast("int")).alias("good"), F.max(F.col("toxic").eqNullSafe(1).cast("int")).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "failed", "good", "toxic"]
    groups = (
        rows.groupBy(*kind, "doc_id")
        .agg(F.count("*").alias("n"))
        .groupBy(*kind)
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("named"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("at_least"))
    )
    lowest = F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("copies", F.col("named") - F.when(F.col("least") == lowest, F.col("at_least")).otherwise(0))
    split = F.array(F.struct(F.col("failed"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("failed") + 16).alias("failed"), F.col("copies").alias("n")))
    return groups.select("part", "good", "toxic", F.explode(split).alias("x")).where("x.n > 0").select("part", "x.failed", "good", "toxic", "x.n")


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of every part of a task, 600 each, with its own counts; all counts are sums over documents."""
    parts: dict[str, np.ndarray] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for part, sums in parts.items():
            removed, good, toxic = sums[:, :, 0], sums[:, :, 1], sums[:, :, 2]
            total = removed[0].sum()
            # documents by failed filters: those that an order with f in front removes at once
            fails = np.array([removed[next(i for i, o in enumerate(ORDERS) if o[0] == f), 0] for f in FILTERS])
            alone = np.array([removed[next(i for i, o in enumerate(ORDERS) if o[-1] == f), STEPS - 1] for f in FILTERS])
            share = np.bincount(LETTER.ravel(), removed[:, :STEPS].ravel(), STEPS).astype(np.int64)
            columns = {
                "kept": total - np.cumsum(removed[:, :STEPS], axis=1),
                "removed": removed[:, :STEPS],
                "redundant": fails[LETTER] - removed[:, :STEPS],
                "unique_fails": alone[LETTER],
                "good_lost": good[:, :STEPS],
                "toxic_lost": toxic[:, :STEPS],
                "shapley": share[LETTER],
            }
            n = len(ORDERS) * STEPS
            fixed = [pa.array([part] * n), pa.array(np.repeat(ORDERS, STEPS).tolist()), pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))]
            yield pa.RecordBatch.from_arrays([*fixed, *(pa.array(columns[c].ravel().astype(np.int64)) for c in _COUNTS)], names=["part", "filter_order", "step", *_COUNTS])
        parts.clear()

    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        sets, good, toxic, n = (batch.column(i).to_numpy() for i in range(1, 5))
        for k, name in enumerate(names):
            own = np.flatnonzero(codes == k)
            sums = parts.setdefault(name, np.zeros((len(ORDERS), STEPS + 1, 3), np.int64))
            for at in range(0, len(own), _LOOKED_UP):
                rows = own[at : at + _LOOKED_UP]
                place = (np.arange(len(ORDERS)) * (STEPS + 1) + FIRST[sets[rows]]).ravel()
                for j, weight in enumerate((n[rows], n[rows] * good[rows], n[rows] * toxic[rows])):
                    counted = np.bincount(place, np.repeat(weight, len(ORDERS)), len(ORDERS) * (STEPS + 1))
                    sums[:, :, j] += counted.reshape(len(ORDERS), STEPS + 1).astype(np.int64)
            if len(parts) >= MOST_PARTS:
                yield from flushed()
    yield from flushed()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for every part, order of the five filters and step; an empty table has none.

    Parts are the values of source, null as the empty string. Repeated rows count as often as they occur, other columns
    of docs and labels change nothing, and labels without a document are ignored.
    """
    rows = tallies(docs, labels).select("part", "failed", "good", "toxic", "n")
    found = rows.mapInArrow(_partial, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS))
    return found.groupBy("part", "filter_order", "step").agg(*(F.sum(c).alias(c) for c in _COUNTS))


#: The contract in DuckDB SQL: documents by failed filters, then each order's first failed filter.
ORACLE = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
fails AS (
  SELECT doc_id, part, map {
    'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
    'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS bad
  FROM doc),
label AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, bad, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS x
  FROM fails LEFT JOIN label USING (doc_id) GROUP BY part, bad),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (SELECT filter_order, step, filter_order[step] AS f FROM orders, unnest(range(1, 6)) AS s(step)),
met AS (
  SELECT part, filter_order, step, f, n, g, x, bad[f] AS fail,
         len(list_filter(range(1, step), lambda i: bad[filter_order[i]])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda i: bad[i])) = 1 AS one
  FROM counts, steps),
sums AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN NOT gone AND NOT fail THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fail THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND fail THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fail AND one THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND fail THEN g ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fail THEN x ELSE 0 END) AS toxic_lost
  FROM met GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM sums
"""
