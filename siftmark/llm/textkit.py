"""Vectorised word, line and k-gram hashing over Arrow string columns, and a few Spark helpers.

Texts are taken as UTF-8 bytes: both word classes used here are closed under
UTF-8 (all bytes from 0x80 up are word bytes), so no decoding is needed.
A hash of a byte run is the polynomial sum of random per-byte values modulo
2**64, finished with a mixing step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..sources.durable import kept as durable

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text hashed at once; temporaries take about 60 times as much.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(_BASE)) | _U(1)


EXACT = constants(256, 1)
#: As EXACT, with A-Z taken as a-z.
FOLDED = EXACT.copy()
FOLDED[65:91] = FOLDED[97:123]

#: Bytes of a word `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, _U)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 4 * CHUNK:
            _powers[name] = have
    return have[:n]


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the texts in them); nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the bounds of texts end a run."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    filled = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[filled] = False
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def sums(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums that span_hashes() takes."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * _power("up", _BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = _power("down", _INVERSE, len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(_U))


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last of every word, and where each text's words begin (one more at the end)."""
    starts, ends = runs(kind[data], offsets)
    first = np.searchsorted(starts, offsets)
    return span_hashes(sums(data, values), starts, ends), starts, ends, first


_GRAM = constants(64, 2)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i + k] for every i with k words left."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    total = words[:n] * _GRAM[0]
    for j in range(1, k):
        total = total + words[j : n + j] * _GRAM[j]
    return mix(total)


def words_list(text: str | None, kind: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Word hashes of one text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    return words_of(data, np.array([0, len(data)]), kind, values)[0]


#: Rows that go to a Python worker at once: texts are long, so few rows are much data.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds of its input, for the queries of this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def give_back() -> None:
    """Return what a worker's allocators keep of freed memory; workers stay for later tasks, beside those that run then."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def lean(go: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """go for mapInArrow(), in workers that keep little between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from go(batches)
        finally:
            give_back()

    return run


def scanned(df: DataFrame) -> DataFrame:
    """durable() for what comes from a pass over the texts: more tasks a core, as each has much to read."""
    return durable(df, 16)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
