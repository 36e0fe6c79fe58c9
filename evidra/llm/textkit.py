"""Vectorised views of Arrow string columns: bytes, documents and words without a Python object for each.

Batches are worked through in slices of bounded text, so memory does not follow the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

#: Byte classes: ASCII letters, digits and all bytes of non-ASCII characters make words.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Random odd multiplier and byte values of the word hash, from a fixed seed.
_RNG = np.random.default_rng(20_240_601)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[str, np.ndarray] = {}
#: Caches of this Python worker, which outlive the task and the step that filled them.
_caches: list = []


def worker_cache(f: Callable) -> Callable:
    """``lru_cache`` for what a worker keeps from task to task, until it goes on to a step that calls ``forget``."""
    _caches.append(cached := lru_cache(maxsize=2)(f))
    return cached


def forget() -> None:
    """Give back what other steps have kept in this worker: Spark hands its workers on from step to step."""
    kept = [c for c in _caches if c.cache_info().currsize]
    for c in kept:
        c.cache_clear()
    if kept:
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[str(base)] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, int64) of a string array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not n or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(
    batch: pa.RecordBatch, text: str, max_bytes: int = SLICE_BYTES, max_rows: int = 1 << 30
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``max_bytes`` of text and ``max_rows`` at most: first row, last row + 1, bytes, offsets."""
    data, offsets = utf8(batch.column(text))
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + max_bytes, side="right")) - 1
        b = min(n, max(b, a + 1), a + max_rows)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document's run; 0 for an empty one."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the offsets of documents in that list. A word never crosses documents."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = _IN_WORD[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]])  # two words meet where one document ends
    at = np.flatnonzero(edge)
    if len(cut):
        at = np.sort(np.concatenate([at, cut, cut]))
    starts, ends = at[::2], at[1::2]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words, ASCII letters lower-cased: a polynomial of byte values, scrambled."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[_LOWER[data]] * _power(_BASE, n), out=total[1:])
    # The word's own polynomial: shifted down by its start, so that place does not matter.
    h = (total[ends] - total[starts]) * _power(_BASE_INVERSE, n + 1)[starts]
    return mix64(h ^ (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, firsts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and the documents' offsets in them; a shorter document has one run."""
    count = np.diff(firsts)
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(runs)])
    total = int(bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), bounds
    at = np.arange(total) - np.repeat(bounds[:-1] - firsts[:-1], runs)
    last = np.repeat(firsts[1:], runs)
    h = np.zeros(total, np.uint64)
    step = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        i = at + k
        ok = i < last
        h = h * step + np.where(ok, hashes[np.minimum(i, len(hashes) - 1)], np.uint64(0))
    return mix64(h), bounds
