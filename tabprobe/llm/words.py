"""Vectorised word spans and hashes over a batch of texts (numpy, inside tasks).

Texts are handled as one byte buffer with offsets, in slices of about a megabyte, so memory per
task does not follow the batch. Hashes depend on a span's bytes alone, not on its place.
"""

from __future__ import annotations

import numpy as np

CHUNK_BYTES = 1 << 20
# [\x20\x09-\x0D]
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
# Classes: 0 blank, 1 letters, digits and all non-ASCII bytes, 2 other marks.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[BLANK] = 0
CLASSES[48:58] = CLASSES[65:91] = CLASSES[97:123] = CLASSES[128:] = 1
WORDS = np.where(BLANK, 0, 1).astype(np.uint8)

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n + 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        made = []
        for base in (BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))  # wraps mod 2^64
        _POWERS[size] = tuple(made)
    return _POWERS[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def chunks(array, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of consecutive slices of an Arrow string array; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = pc.fill_null(array.cast(pa.large_string()), "")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(array):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        stop = min(stop, len(array))
        yield row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
        row = stop


def spans(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = WORDS):
    """(start, end, text number) of maximal runs of one class other than 0, within a text."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    kind = classes[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    start, end = cuts[:-1], cuts[1:]
    solid = kind[start] != 0
    start, end = start[solid], end[solid]
    return start, end, np.searchsorted(offsets, start, "right") - 1


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * power[end])


def shingles(word: np.ndarray, text: np.ndarray, n_texts: int, k: int):
    """(hash, text number) of every k consecutive words of a text, in order; a text with fewer
    words gives its whole sequence as one."""
    counts = np.bincount(text, minlength=n_texts)
    first = np.cumsum(counts) - counts
    out_h, out_t = [], []
    factor = np.uint64(0xD6E8FEB86659FD93)
    if len(word) >= k:
        acc = word[:len(word) - k + 1].copy()
        for j in range(1, k):
            acc = mix(acc * factor + word[j:len(word) - k + 1 + j])
        same = text[:len(word) - k + 1] == text[k - 1:]
        out_h.append(acc[same])
        out_t.append(text[:len(word) - k + 1][same])
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            acc = word[first[short]].copy()
            for j in range(1, m):
                acc = mix(acc * factor + word[first[short] + j])
            out_h.append(mix(acc + np.uint64(m)))
            out_t.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, t = np.concatenate(out_h), np.concatenate(out_t)
    order = np.argsort(t, kind="stable")
    return h[order], t[order]


def distinct(h: np.ndarray, t: np.ndarray, n_texts: int):
    """Sorted distinct hashes per text: (hashes, offsets)."""
    counts = np.bincount(t, minlength=n_texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    sets = [np.unique(h[at[i]:at[i + 1]]) for i in range(n_texts)]
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])
