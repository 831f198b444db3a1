"""Vectorised words and shingles of Arrow string columns.

A word is a maximal run of bytes other than space and \\t..\\r, with A-Z lowered.
Words become 64-bit hashes (a polynomial over random byte values), shingles become
64-bit hashes of word hashes; nothing else of the text is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SEP = np.zeros(256, bool)
_SEP[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.randint(0, 1 << 63, 64, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = np.where(_SEP, np.uint64(0), _BYTE)
_VALUE_LOW = np.where(_SEP, np.uint64(0), _BYTE[_LOWER])
BLOCK = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64 (multiply and shift rounds)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_block(data: np.ndarray, first: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start positions, hashes) of the words of ``data``; ``first`` marks bytes that begin a text."""
    is_word = ~_SEP[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | first[1:]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    values = (_VALUE_LOW if lower else _VALUE)[data[starts[0] :]]
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(len(values), dtype=np.int64) - np.repeat(starts - starts[0], lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _R, np.uint64))
    return starts, mix(np.add.reduceat(values * powers[place], starts - starts[0]))


def word_hashes(col: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, word offsets of each text: length texts + 1).

    Works through blocks of a quarter of a megabyte, cut between words, so that one very long text needs no more
    than its hashes.
    """
    data, offsets = utf8_of(col)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            seps = np.flatnonzero(_SEP[data[at:end]])
            if len(seps):
                end = at + int(seps[-1]) + 1
            else:
                rest = np.flatnonzero(_SEP[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        s, h = _hash_block(data[at:end], first[at:end], lower)
        places.append(s + at)
        hashes.append(h)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def slices(col: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most about ``most_bytes`` of text, one row at least."""
    _, offsets = utf8_of(col)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def shingle_hashes(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of k consecutive words, not across texts: (hashes in order, offsets of each text).

    A text with fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    out_bounds = np.concatenate([[0], np.cumsum(count)])
    if not out_bounds[-1]:
        return np.empty(0, np.uint64), out_bounds
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    for j in range(k):
        total += padded[j : j + len(h)] * _STEP[j]
    doc = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(h)) - bounds[:-1][doc] <= (n - k)[doc]
    out = np.zeros(out_bounds[-1], np.uint64)
    long_ones = np.repeat(n >= k, count)
    out[long_ones] = mix(total[inside])
    for d in np.flatnonzero((n > 0) & (n < k)):
        w = h[bounds[d] : bounds[d + 1]]
        out[out_bounds[d]] = mix((w * _STEP[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))[0]
    return out, out_bounds


_CLASS = np.zeros((3, 256), np.int32)  # capital, letter (any byte of a non-ASCII character counts), other sign
_CLASS[0, 65:91] = 1
_CLASS[1, 65:91] = _CLASS[1, 97:123] = _CLASS[1, 128:] = 1
_CLASS[2] = ~(_SEP | _CLASS[1].astype(bool))


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    is_word = ~_SEP[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | first[1:-1]
    return np.flatnonzero(begins)


def word_shapes(col: pa.Array) -> np.ndarray:
    """One small code per word, in the order of ``word_hashes``: use of capitals, of letters and of other signs."""
    data, offsets = utf8_of(col)
    starts = word_starts(data, offsets)
    if not len(starts):
        return np.empty(0, np.uint64)
    caps, letters, other = (np.add.reduceat(_CLASS[k][data], starts) for k in range(3))
    case = np.where(caps == 0, 0, np.where((caps == letters) & (caps > 1), 3, np.where(caps == 1, 1, 2)))
    return (case + 4 * np.minimum(other, 3) + 16 * (letters == 0) + 32 * np.minimum(letters // 8, 3)).astype(np.uint64)
