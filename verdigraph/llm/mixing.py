"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot k of the mix has the k-th van der Corput point (base 2); the point's place among the cumulative targets
names the slot's source. Slots are ranked within their source, and rank r takes the block that a keyed shuffle
puts at place r modulo the number of blocks, so a source is read evenly, in passes, and a block knows its ranks. Blocks cut the source's
words, in a keyed order of its documents, into equal runs.

With 2**m slots the points are the multiples of 2**-m, so a source's slots are the bit reversals of a range of
integers: their number follows from the range, and a rank's slot from the bits of the integers in it. No slot is
compared with sources, and none has to be looked up. Running sums are two-level (bucket totals, then inside buckets), so that a source with
a third of all rows is spread over many tasks. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigraph.llm import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
#: The schedule's slots are the least power of two that gives blocks of LEAST_BLOCK words at most, whatever the corpus holds.
LEAST_BLOCK = 8
KEY = "mix"
#: Schedule integers that one row of the generating table expands to.
_CHUNK = 16384
#: Up to so many sources are broadcast to their blocks.
MOST_SOURCES = 100_000
#: Slots, and about as many blocks, that meet in one partition.
_TABLE_ROWS = 500_000


def running(df: DataFrame, group: str, bucket: str, order: list[Column], weight: Column, out: str) -> DataFrame:
    """df with `out`: the sum of weight over the rows of the same group before this one, by bucket and then by order.

    The merge join shares its exchange with the window; Spark's size estimates, which ignore what an explode
    makes, must not choose a broadcast here.
    """
    df = df.withColumn("__weight", weight)
    totals = df.groupBy(group, bucket).agg(F.sum("__weight").alias("__total"))
    # the columns that tell rows apart come first in every key, as sorts look at the first one before all others
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, bucket, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(bucket, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.hint("merge").join(totals, [bucket, group]).withColumn(out, F.col("__before") + F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    return df.drop("__weight", "__before")


def _spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as a shuffle has; each of its rows is about to become many."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "first")


def sized(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, source, src, size, mark): words of the text (null: 0), a source key that is never null, a keyed shuffle mark."""
    return docs.select(
        "doc_id",
        "source",
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{key}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit(""))))))).alias("mark"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_PASSES) -> DataFrame:
    """One row per source of `sized` rows: source_size, weight, target, before (targets of the sources in front), budget.

    The targets share `share` times all words by weight; what is above `most` times a source's words is shared
    again by weight until none is above. In closed form: with the sources by cap over weight, the level at the
    first source that stays under its cap gives every target as least(cap, level * weight).
    The windows without partitions run over this table of one row per source.
    """
    per = rows.groupBy("src", "source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), place + 1)
    per = per.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size"))
    per = per.withColumn("budget", F.lit(share) * F.sum("source_size").over(everything))
    by_cap = everything.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    front, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(front), F.lit(0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"])
    per = per.withColumn("target", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")))
    ahead = by_name.rowsBetween(Window.unboundedPreceding, -1)
    return per.select("src", "source", "source_size", "weight", "target", F.coalesce(F.sum("target").over(ahead), F.lit(0.0)).alias("before"), "budget")


def scheduled(sources: DataFrame, bits: int) -> DataFrame:
    """(src, low, high): which multiples of 2**-bits, the sorted points of the schedule, lie in each source's part."""
    n = float(1 << bits)
    edge = lambda c: F.least(F.ceil(c / F.col("budget") * F.lit(n)), F.lit(1 << bits))
    return sources.where("target > 0").select("src", edge(F.col("before")).alias("low"), edge(F.col("before") + F.col("target")).alias("high")).where("low < high")


def slots(sources: DataFrame, bits: int) -> DataFrame:
    """(src, slot, rank): 2**bits slots of the schedule and their rank inside their source."""
    own = scheduled(sources, bits)
    own = _spread(own.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") - F.col("low") - 1, F.lit(_CHUNK).cast("long")))))
    own = own.select("src", "low", "high", F.explode(F.sequence("first", F.least(F.col("high") - F.col("low"), F.col("first") + _CHUNK) - 1)).alias("rank"))
    return own.select("src", _slot(F.col("rank"), F.col("low"), F.col("high"), bits).alias("slot"), "rank")


def _slot(rank: Column, low: Column, high: Column, bits: int) -> Column:
    """The slot of a source's rank-th point in the order of the schedule. Slots are the reversed bits of low..high-1, so
    bit by bit, from the lowest, the rank tells whether the point is among those with a 0 there or among those with a 1."""

    def step(a: Column, j: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), j + 1)
        below = lambda edge: F.floor((edge - a["point"] + size - 1) / size)  # noqa: E731  # of the points with these low bits and a 0 next
        zeros = below(high) - below(low)
        one = a["rank"] >= zeros
        bit = F.when(one, F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.struct((a["point"] + bit * F.call_function("shiftleft", F.lit(1).cast("long"), j)).alias("point"), (a["rank"] - F.when(one, zeros).otherwise(F.lit(0))).cast("long").alias("rank"), (2 * a["slot"] + bit).alias("slot"))

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("point"), rank.cast("long").alias("rank"), zero.alias("slot"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), start, step, lambda a: a["slot"]) if bits else zero


def _shape(sources: DataFrame) -> tuple[int, float]:
    """Bits of the schedule and words of a block."""
    budget = sources.agg(F.max("budget")).first()[0] or 0.0
    bits = max(0, math.ceil(math.log2(max(1.0, budget / LEAST_BLOCK))))
    return bits, max(budget / (1 << bits), 1.0)


def _pieces(rows: DataFrame, block: float) -> DataFrame:
    """(sid, block, doc_id, start, size, from_word, to_word): documents cut at the edges of their source's blocks. sid is
    a number for the source, as most rows of the mix are these."""
    low = lambda i: F.floor(i * F.lit(block))
    docs = running(rows.withColumn("bucket", F.substring("mark", 1, 3)), "src", "bucket", [F.col("mark"), F.col("doc_id"), F.col("size")], F.col("size"), "start")
    docs = docs.where("size > 0")
    end = F.col("start") + F.col("size")
    near = F.sequence(F.greatest(F.floor(F.col("start") / F.lit(block)) - 1, F.lit(0)), F.floor((end - 1) / F.lit(block)) + 1)
    pieces = docs.select(F.xxhash64("src").alias("sid"), "doc_id", "start", "size", F.explode(near).alias("block"))
    pieces = pieces.withColumn("from_word", F.greatest(low(F.col("block")), F.col("start")) - F.col("start"))
    return pieces.withColumn("to_word", F.least(low(F.col("block") + 1), F.col("start") + F.col("size")) - F.col("start")).where("from_word < to_word")


def _filled(sources: DataFrame, bits: int, block: float, key: str) -> DataFrame:
    """(sid, block, place, last, src, low, high, blocks): blocks that the schedule takes. A block's ranks are its place and,
    in each of `last` later passes, that many blocks more. What all blocks of a source share joins them at the end."""
    count = F.ceil(F.col("source_size") / F.lit(block))  # blocks of a source; floors leave the last one empty at most
    per = sources.where("source_size > 0").select("src", F.xxhash64("src").alias("sid"), count.alias("blocks")).join(scheduled(sources, bits), "src")
    per = common.staged(per, "mix-source-blocks")
    dealt = _spread(per.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1, F.lit(_CHUNK)))))
    dealt = dealt.select("sid", "src", F.explode(F.sequence("first", F.least(F.col("blocks"), F.col("first") + _CHUNK) - 1)).alias("block"))
    mark = F.conv(F.substring(F.md5(F.concat(F.lit(f"{key}:"), "src", F.lit(":"), F.col("block").cast("string"))), 1, 15), 16, 10).cast("long")
    dealt = dealt.select("sid", "block", mark.alias("mark")).withColumn("bucket", F.shiftright("mark", 48).cast("int"))
    placed = running(dealt, "sid", "bucket", [F.col("mark"), F.col("block")], F.lit(1), "place").select("sid", "block", F.col("place").cast("long").alias("place"))
    placed = placed.join(F.broadcast(per), "sid") if per.count() <= MOST_SOURCES else placed.hint("merge").join(per, "sid")
    slots_of = F.least(F.col("high") - F.col("low"), MOST_PASSES * F.col("blocks"))
    last = F.floor((slots_of - 1 - F.col("place")) / F.col("blocks"))
    return placed.where(F.col("place") < slots_of).select("sid", "block", "place", last.alias("last"), "src", "low", "high", "blocks")


def _met(filled: DataFrame, pieces: DataFrame, bits: int) -> DataFrame:
    """Blocks with their pieces. Keys are spread evenly and partitions are made by their number, so each holds a hash table
    of bounded size: no sorts."""
    parts = max(int(filled.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // _TABLE_ROWS + 1)
    keyed = lambda df: df.repartition(parts, "block", "sid")
    return keyed(filled).join(keyed(pieces).hint("shuffle_hash"), ["block", "sid"])


def plan(rows: DataFrame, sources: DataFrame, key: str = KEY) -> DataFrame:
    """(slot, pass, src, block, doc_id, start, size, from_word, to_word): which words of which document fill each slot.

    rows: staged `sized` rows; sources: staged `targets`. start is the document's place in its source's word
    stream. Documents without words fill nothing.
    """
    bits, block = _shape(sources)
    found = _met(_filled(sources, bits, block, key), _pieces(rows, block), bits).withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    slot = _slot(F.col("place") + F.col("pass") * F.col("blocks"), F.col("low"), F.col("high"), bits)
    return found.select(slot.alias("slot"), "pass", "src", "block", "doc_id", "start", "size", "from_word", "to_word")


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of docs.

    Null texts have size 0; null sources are one source, last in order; repeated rows are documents of their
    own; an empty table gives no rows. taken counts the words of the row that the schedule takes, repeats included.
    """
    rows = common.staged(sized(docs), "mix-sizes")
    sources = common.staged(targets(rows), "mix-sources")
    # rows that agree in doc_id, source and size are interchangeable but have places of their own in the stream
    placed = running(rows.withColumn("bucket", F.substring("mark", 1, 3)), "src", "bucket", [F.col("mark"), F.col("doc_id"), F.col("size")], F.col("size"), "start")
    bits, block = _shape(sources)
    times = _filled(sources, bits, block, KEY).select("sid", "block", (F.col("last") + 1).cast("int").alias("times"))
    words = _pieces(rows, block).select("sid", "block", "start", (F.col("to_word") - F.col("from_word")).cast("int").alias("words"))
    taken = _met(times, words, bits).groupBy("start", "sid").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    out = placed.where("size > 0").withColumn("sid", F.xxhash64("src")).hint("merge").join(taken, ["start", "sid"], "left").select("doc_id", "src", "size", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    out = out.unionByName(rows.where("size = 0").select("doc_id", "src", "size", F.lit(0).cast("long").alias("taken")))
    return out.join(sources.select("src", "source_size", "target"), "src").select("doc_id", "size", "source_size", "target", "taken")


#: The same schedule in DuckDB SQL.
ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '-' || md5(coalesce(text, '')))) AS mark
  FROM documents),
per AS (
  SELECT src, source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         1.5::DOUBLE * sum(sum(size)) OVER ()::DOUBLE AS budget
  FROM rows_ GROUP BY src, source),
levels AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lvl
  FROM per),
tgt AS (
  SELECT *, coalesce(least(cap::DOUBLE, (arg_min(lvl, cap::DOUBLE / weight) FILTER (lvl * weight <= cap) OVER ()) * weight), cap::DOUBLE) AS target
  FROM levels),
sources AS (
  SELECT *, coalesce(sum(target) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS ahead FROM tgt),
shape AS (
  SELECT bits, greatest(budget / (1::BIGINT << bits), 1.0) AS b FROM (
    SELECT max(budget) AS budget, greatest(0, ceil(log2(greatest(1.0, max(budget) / 8))))::INT AS bits FROM per)),
slot AS (
  SELECT src, row_number() OVER (PARTITION BY src ORDER BY reverse(lpad(bin(point), greatest(1, bits), '0'))) - 1 AS rank
  FROM (SELECT src, bits, unnest(range(least(ceil(ahead / budget * (1::BIGINT << bits)), 1::BIGINT << bits)::BIGINT,
                                       least(ceil((ahead + target) / budget * (1::BIGINT << bits)), 1::BIGINT << bits)::BIGINT)) AS point
        FROM sources, shape WHERE target > 0)),
blocks AS (SELECT src, ceil(source_size / b)::BIGINT AS n, unnest(range(0, ceil(source_size / b)::BIGINT)) AS block FROM sources, shape),
shuffled AS (SELECT src, n, block, row_number() OVER (PARTITION BY src ORDER BY left(md5('mix:' || src || ':' || block), 15), block) - 1 AS place FROM blocks),
times AS (
  SELECT s.src, s.block, count(*) AS times
  FROM slot JOIN (SELECT DISTINCT src, n FROM shuffled) AS c USING (src) JOIN shuffled AS s ON s.src = slot.src AND s.place = slot.rank % c.n
  WHERE slot.rank < 2 * c.n GROUP BY ALL),
placed AS (
  SELECT row_number() OVER () AS rid, *, coalesce(sum(size) OVER (PARTITION BY src ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows_),
pieces AS (
  SELECT rid, src, block, least(floor((block + 1) * b)::BIGINT, start + size) - greatest(floor(block * b)::BIGINT, start) AS words
  FROM (SELECT *, unnest(range(greatest(floor(start / b)::BIGINT - 1, 0), floor((start + size - 1) / b)::BIGINT + 2)) AS block FROM placed, shape WHERE size > 0)),
took AS (SELECT rid, sum(words * times)::BIGINT AS taken FROM pieces JOIN times USING (src, block) WHERE words > 0 GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed JOIN sources USING (src) LEFT JOIN took USING (rid)
"""
