"""Numpy helpers over the UTF-8 buffers of an Arrow string column, used inside Spark tasks.

Everything works on blocks of about a MB, so a task's memory does not depend on the size of
its partition; a block holds whole texts, and a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlane.llm.common import named

BLOCK = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


BYTE_KEYS = _table(20)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, BLOCK + 1), base & _MASK, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 4 * BLOCK:  # those of a longer text are not kept
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def column(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; NULL is an empty text."""
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    data = arr.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def blocks(data: np.ndarray, offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text + 1, their bytes, their offsets from 0)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


class Runs(NamedTuple):
    """Maximal runs of wanted bytes, each within one text."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def runs(wanted: np.ndarray, offsets: np.ndarray) -> Runs:
    n = len(wanted)
    if not n:
        none = np.zeros(0, np.int64)
        return Runs(none, none, none)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = wanted.copy()
    starts[1:] &= ~wanted[:-1] | edge[1:n]
    ends = wanted.copy()
    ends[:-1] &= ~wanted[1:] | edge[1:n]
    start = np.flatnonzero(starts)
    return Runs(start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1)


class Hasher:
    """64-bit hashes of any byte ranges of a block, from one pass of prefix sums."""

    def __init__(self, data: np.ndarray, keys: np.ndarray = BYTE_KEYS):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(keys[data] * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(pow(_BASE, -1, 1 << 64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per byte) in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n)


def shingles(hashes: np.ndarray, doc: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and their texts; a text of 1 to n-1 words has one shingle, all its words."""
    order = powers(0xD6E8FEB86659FD93, n)
    total = len(hashes)
    if not total:
        return hashes, doc
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    length = np.diff(np.r_[first, total])
    acc = np.zeros(max(0, total - n + 1), np.uint64)
    for i in range(n if len(acc) else 0):
        acc += hashes[i : total - n + 1 + i] * order[i]
    fits = doc[: len(acc)] == doc[n - 1 :] if len(acc) else np.zeros(0, bool)
    short, short_doc = [], []
    for size in range(1, n):
        at = first[length == size]
        x = np.full(len(at), size, np.uint64)
        for i in range(size):
            x = x + hashes[at + i] * order[i]
        short.append(x)
        short_doc.append(doc[at])
    values = mix(np.concatenate([acc[fits], *short]))
    owner = np.concatenate([doc[: len(acc)][fits], *short_doc])
    by = np.argsort(owner, kind="stable")
    return values[by], owner[by]


def sequence_keys(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """16 bytes for each text's word sequence; zeros for a text without words."""
    out = np.zeros((n, 2), np.uint64)
    if len(hashes):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        place = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
        for i, base in enumerate((0xA24BAED4963EE407, 0x9FB21C651E98DF25)):
            terms = mix(hashes + U(i)) * powers(base, int(place.max()) + 1)[place]
            out[doc[first], i] = mix(np.add.reduceat(terms, first)) | U(1)
    return out


def binary(rows: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in rows], pa.binary())


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(_BASE, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(pow(_BASE, -1, 1 << 64), n + 1)[: n - width + 1])


def lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    """Lists of the given sizes over ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def mapped(docs: DataFrame, kept: list[str], text: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], added: str) -> DataFrame:
    """``run`` over Arrow batches (row, text): the ``kept`` columns travel as one struct, so that any name and type goes."""
    row = F.struct(F.lit(0).alias("__pairlane_row"), *map(named, kept)).alias("row")  # never empty
    rows = docs.select(row, F.col(text).alias("text"))
    new = T.StructType.fromDDL(added)
    out = rows.mapInArrow(run, T.StructType([rows.schema["row"], *new.fields]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], *new.names)
