"""Words ``[^\\x20\\x09-\\x0D]+`` of whole texts as numpy arrays: offsets and 64-bit fingerprints.

Texts stay UTF-8 bytes in Arrow's own buffers. A chunk of texts is scanned at once, so the cost per word is a few array
operations and memory is bounded by the chunk (or by the longest single text).
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """An invertible 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, 1 << 64))
        done += take
    return out


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 2 * self.n, 1 << 16)
            self.up, self.down = _powers(self.base, self.n), _powers(self.inverse, self.n)
        return self.up[:n], self.down[:n]


_BYTES = _Powers(_BASE)
_WORDS = _Powers(0xD6E8FEB86659FD93)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Words:
    """The words of a chunk of texts.

    ``data`` holds the bytes of all texts, ``start``/``end`` the bytes of each word, and words
    ``first[i]:first[i + 1]`` belong to text ``i``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        ink = ~_SPACE[data]
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = ink[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        self.start = np.flatnonzero(ink & ~before)
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = ink[1:]
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.end = np.flatnonzero(ink & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A fingerprint of each word; ``lower`` folds A-Z only."""
        table = _TABLE[_LOWER] if lower else _TABLE
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):
            # A segment of whole words at a time, so that one very long text needs no longer tables of powers.
            a = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.start, a + SEGMENT_BYTES)))
            start, end = self.start[i:j] - a, self.end[i:j] - a
            up, down = _BYTES.upto(int(end[-1]))
            total = np.empty(len(up) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(table[self.data[a : a + len(up)]] * up, out=total[1:])
            # The length keeps words apart whose polynomials agree.
            out[i:j] = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
            i = j
        return out

    def text_of(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of ``k`` consecutive word fingerprints (also across texts: callers mask those)."""
    if len(h) < k:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORDS.upto(len(h))
    total = np.empty(len(h) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(h * up, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(h) - k + 1] + np.uint64(k))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string array into runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets).

    A null counts as an empty text. A single longer text makes a run of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, side="right")) - 1)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


#: What a worker process keeps for later tasks of the same operator.
KEPT: dict = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False) -> Callable:
    """``run`` as a good neighbour: workers live on and wait beside those of later stages, so freed memory is given back
    at the end, and what another operator has kept is dropped at the start (unless ``run`` uses it)."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            KEPT.clear()
        try:
            yield from run(batches)
        finally:
            if not keeps:
                KEPT.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped
