"""Whole-column text kernels on UTF-8 bytes: one numpy pass a column slice instead of one Python call a word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word for the contamination rule: digits, a-z after lower-casing, all bytes of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
#: White space that parts the words of shingles.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_RNG = np.random.default_rng(20240229)
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.ones(1, np.uint64)
#: Bytes of spans that are hashed at once.
SPAN_BYTES = 1 << 19


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of up to limit bytes; a longer row stands alone and whole."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at row borders."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: random byte values times powers of an odd base, then mixed."""
    global _POWER
    lengths = ends - starts
    out = lengths.astype(np.uint64)
    longest = int(lengths.max()) if len(lengths) else 0
    if longest > len(_POWER):
        _POWER = np.full(max(64, 2 * longest), 0x9E3779B97F4A7C15, np.uint64)
        _POWER[0] = 1
        _POWER = np.cumprod(_POWER)
    total = np.concatenate([[0], np.cumsum(lengths)])
    for a, b in slices(total, SPAN_BYTES):
        edge = total[a:b] - total[a]
        n = lengths[a:b]
        within = np.arange(total[b] - total[a]) - np.repeat(edge, n)
        values = _VALUE[data[np.repeat(starts[a:b], n) + within]] * _POWER[within]
        some = n > 0
        if some.any():
            out[a:b][some] += np.add.reduceat(values, edge[some])
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def trim() -> None:
    """Gives freed memory back, so that a worker that is used again does not keep the peak of each operator."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and row, first and end byte of each word of the contamination rule, in order."""
    low = LOWER[data]
    starts, ends = spans(WORD[low], offsets)
    return low, np.searchsorted(offsets, starts, "right") - 1, starts, ends


def same(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which spans of a and b (of one length each, not empty) hold the same bytes."""
    out = np.ones(len(lengths), bool)
    total = np.concatenate([[0], np.cumsum(lengths)])
    for i, j in slices(total, SPAN_BYTES):
        edge, n = total[i:j] - total[i], lengths[i:j]
        within = np.arange(total[j] - total[i]) - np.repeat(edge, n)
        out[i:j] = np.logical_and.reduceat(a[np.repeat(at_a[i:j], n) + within] == b[np.repeat(at_b[i:j], n) + within], edge)
    return out


def spelled(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of the spans, one after the other."""
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return data[np.repeat(starts, lengths) + within]
