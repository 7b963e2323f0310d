"""Burrows-Wheeler transform and longest common prefixes of many short texts, built column by column.

Round j inserts the symbol that is j-th from the end of every text still that long, all at once: the new suffixes are
ordered by (symbol, rank of the suffix behind it), merged into the sorted collection, and the common prefixes next to
them follow from the least common prefix between the two suffixes behind. Each round reads and writes its columns from
one end to the other. A symbol is `width` bytes; a text is read once in each of the `width` phases.
"""

from __future__ import annotations

import numpy as np

_RANK = (1 << 32) - 1


def _least_between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of lcp over [low, high] for each pair."""
    out = np.zeros(len(low), lcp.dtype)
    if len(low):
        order = np.argsort(low, kind="stable")
        bounds = np.empty(2 * len(low), np.int64)
        bounds[::2], bounds[1::2] = low[order], high[order] + 1
        out[order] = np.minimum.reduceat(np.append(lcp, lcp.dtype.type(0)), bounds)[::2]
    return out


def construct(symbols: np.ndarray, first: np.ndarray, count: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in sorted order (-1 for ends of texts), and the symbols each shares with the one before.

    Text t has count[t] symbols, at first[t], first[t] + step, ...; ends of texts sort first and differ from each other.
    """
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    n = len(first)
    keys = np.arange(n, dtype=np.int64)  # symbol + 1 << 32 | rank of the suffix behind; in sorted order
    lcp, place, rank = np.zeros(n, np.int32), np.full(n, -1, np.int64), np.arange(n, dtype=np.int64)
    active = np.searchsorted(-count, -np.arange(1, int(count[0]) + 1 if n else 1), "right")
    for j, k in enumerate(active.tolist(), 1):
        at = first[:k] + step * (count[:k] - j)
        key = (symbols[at] + 1) << 32 | rank[:k]
        turn = np.argsort(key)
        key, behind = key[turn], rank[:k][turn]
        into, size = np.searchsorted(keys, key), len(keys)
        # Neighbours: the one before (old or new), and for the last new one in a gap the old one after.
        before = keys[into - 1]
        follows = np.flatnonzero(into[1:] == into[:-1]) + 1
        before[follows] = key[follows - 1]
        last = np.flatnonzero(np.append(into[1:] != into[:-1], True) & (into < size))
        after = keys[into[last]]
        same = np.flatnonzero(before >> 32 == key >> 32)
        same_after = after >> 32 == key[last] >> 32
        low = np.concatenate([(before[same] & _RANK) + 1, behind[last[same_after]] + 1])
        high = np.concatenate([behind[same], after[same_after] & _RANK])
        common = _least_between(lcp, low, high) + 1
        fresh = np.zeros(k, np.int32)
        fresh[same] = common[: len(same)]
        lcp[into[last]] = 0
        lcp[into[last[same_after]]] = common[len(same) :]
        shift = np.cumsum(np.bincount(into, minlength=size + 1))[:size]
        keys[n:] += shift[keys[n:] & _RANK]
        to = into + np.arange(k)
        old = np.ones(size + k, bool)
        old[to] = False
        merged = []
        for column, new in ((keys, key + shift[behind]), (lcp, fresh), (place, at[turn])):
            both = np.empty(size + k, column.dtype)
            both[old], both[to] = column, new
            merged.append(both)
        keys, lcp, place = merged
        rank[turn] = to
    return place, lcp


def repeated(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, width: int, weights: np.ndarray | None = None) -> np.ndarray:
    """True at each byte of data where a string of `length` bytes starts that starts elsewhere in the texts, too.

    length is a multiple of width (1 to 8 bytes). weights: how often each text occurs. A suffix of a text that occurs more
    than once has its copies as neighbours, with all its symbols in common, so one of them is kept for all.
    """
    out = np.zeros(len(data), bool)
    if not len(starts):
        return out
    used = int(ends.max())
    padded = np.concatenate([data[:used], np.zeros(8, np.uint8)])
    words = np.ndarray((used,), "<u8", padded.tobytes(), strides=(1,))
    words = words & np.uint64((1 << 8 * width) - 1)
    symbols = np.unique(words, return_inverse=True)[1].astype(np.int64)
    phase = np.arange(width)
    first = (starts[:, None] + phase).ravel()
    count = ((ends[:, None] - starts[:, None] - phase) // width).ravel()
    keep = count >= length // width
    place, lcp = construct(symbols, first[keep], count[keep], width)
    long = np.flatnonzero(lcp >= length // width)
    out[place[long]] = True
    out[place[long - 1]] = True
    if weights is not None:
        held = place[place >= 0]
        text = np.searchsorted(starts, held, "right") - 1
        out[held[(weights[text] > 1) & (held + length <= ends[text])]] = True
    return out
