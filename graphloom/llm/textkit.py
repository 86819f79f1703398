"""Words of Arrow text columns as numpy arrays: no Python object is made for a word. Memory of the Python workers that read them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _INVERSE = U64(0x9E3779B97F4A7C15 | 1), U64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_powers = [np.ones(1, U64), np.ones(1, U64)]
#: Of a batch of texts.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 20)
        for k, base in enumerate((_BASE, _INVERSE)):
            all_ = np.full(m, base, U64)
            all_[0] = 1
            _powers[k] = np.multiply.accumulate(all_)
    return _powers[0][:n], _powers[1][:n]


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python BATCH_BYTES at a time, if the session sets no size of its own: by Spark's, a task's texts are one batch, which the JVM and Python each hold twice."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """What this process has freed goes back to the system: Spark keeps a Python worker, with all it holds, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` of a mapInArrow, which gives memory back when its task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``most`` bytes; a longer text is a run of its own."""
    data, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def find_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes other than 0x20 and 0x09-0x0D, and the text it is in."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = False, ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = False, ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs[1:], starts, "right")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased): a polynomial from running sums, then mixed with the length."""
    up, down = powers(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(((LOWER[data] if lower else data).astype(U64) + U64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
