"""Shared plumbing of the corpus operators: staged tables, Arrow passes and vectorised text hashing.

Texts are handled as UTF-8 byte buffers with document offsets, so that one numpy pass serves a whole
Arrow batch; nothing here looks at one character at a time.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from verdigraph.staging import shared_dir, staged  # noqa: F401

CHUNK = 1 << 20
ONE = np.uint64(1)
_WORD_BASE = 0x9E3779B97F4A7C15
_SEQ_BASE = 0xD6E8FEB86659FD93
#: The white space of the contracts: space and \x09 to \x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in a text whose A-Z are lower case.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def appended(df: DataFrame, compute: Callable[[pa.RecordBatch], dict], fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """df with new columns computed batch by batch; a new column replaces an input column of its name (case does not matter)."""
    gone = {f.name.lower() for f in fields} | {x.lower() for x in drop}
    kept = [(i, f) for i, f in enumerate(df.schema.fields) if f.name.lower() not in gone]
    schema = T.StructType([f for _, f in kept] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = compute(batch)
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i, _ in kept), *(made[f.name] for f in fields)], names=[f.name for f in schema.fields])
        trimmed()

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    width = np.dtype(np.int64 if pa.types.is_large_string(column.type) else np.int32)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width, len(column) + 1, column.offset * width.itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `size` bytes; a longer document is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word: maximal runs, inside one document, of the bytes that `table` marks."""
    inside = table[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial sums, from which `window` takes the hash of any range."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + ONE) * powers(base, len(values)), out=out[1:])
    return out


def window(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    inverse = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal ranges have equal hashes wherever they are."""
    return window(prefix(data, _WORD_BASE), starts, ends, _WORD_BASE)


def sequence_hashes(words: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of `length` words inside one document."""
    first = np.arange(max(0, len(words) - length + 1))
    first = first[docs[first] == docs[first + length - 1]]
    return first, window(prefix(words, _SEQ_BASE), first, first + length, _SEQ_BASE)


def run_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of ranges of word hashes; a run of `sequence_hashes` has the hash that it has there."""
    return window(prefix(words, _SEQ_BASE), starts, ends, _SEQ_BASE)


def ranges(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of half-open ranges, as maximal ranges in order."""
    out: list[tuple[int, int]] = []
    for i in np.argsort(starts, kind="stable"):
        s, e = int(starts[i]), int(ends[i])
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def trimmed() -> None:
    """Gives memory that Arrow and the allocator keep back to the system, as Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)
