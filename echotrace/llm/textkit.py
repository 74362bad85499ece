"""Vectorised byte-level text kernels shared by the operators.

Everything here works on the UTF-8 buffers of Arrow string columns, in blocks of
about a megabyte, so a worker's memory does not depend on the batch or on the
corpus.  A single text longer than a block is a block of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, BLOCK + 1024)
        with np.errstate(over="ignore"):
            _pow = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, np.uint64))))
            _inv = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE_INV, np.uint64))))
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: spreads polynomial hashes over all bits."""
    with np.errstate(over="ignore"):
        h = h + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        h ^= h >> np.uint64(30)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and n + 1 offsets of a string or binary column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole texts of about limit bytes."""
    raw, off = buffers(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i], times BASE**-i, the polynomial hash of values[i:j]."""
    pw, _ = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        s = np.empty(len(values) + 1, np.uint64)
        s[0] = 0
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * pw[:-1], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, iv = powers(len(s))
    with np.errstate(over="ignore"):
        return (s[end] - s[start]) * iv[start]


def window_hash(s: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n values."""
    _, iv = powers(len(s))
    if len(s) <= n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        return (s[n:] - s[:-n]) * iv[: len(s) - n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, letters and everything beyond ASCII.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


#: Bytes of letters, with everything beyond ASCII.
LETTER = WORD.copy()
LETTER[48:58] = False


class Words:
    """The words of a block: where they start and end, hashes of their lower-cased bytes, and their texts."""

    def __init__(self, data: np.ndarray, off: np.ndarray, of: np.ndarray = WORD):
        self.data, self.off = data, off
        self.low = LOWER[data]
        inside = of[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0], edge[-1] = True, True
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
        if len(data) == 0:
            edge[:] = False
        else:
            edge[off] = True
        at = np.flatnonzero(edge)
        keep = inside[at[:-1]] if len(at) else np.zeros(0, bool)
        self.start, self.end = (at[:-1][keep], at[1:][keep]) if len(at) else (at, at)
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)
        self.hash = mix(span_hash(prefix_hash(self.low), self.start, self.end)) if len(data) else np.zeros(0, np.uint64)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of the windows of n words that lie in one text."""
        if len(self.hash) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = window_hash(prefix_hash(self.hash), n)
        ok = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return ok, mix(h[ok], n)

    def text(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def lean(run):
    """run, a function over Arrow batches, that gives its memory back when it ends: idle workers stay small."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no glibc
                pass

    return wrapped


def crc32_mod(column, n: int):
    """crc32 of an id as text, modulo n, as a column expression; a null id counts as 0."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % n, F.lit(0))
