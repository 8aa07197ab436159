"""Suffix arrays by induced sorting, and capped permuted common prefixes (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type). The last is not: the end
    counts as the smallest symbol."""
    n = len(s)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1].astype(np.int64))
    step[-1] = -1
    # Within a run of one symbol the type is that of the run's end.
    at = np.where(step != 0, np.arange(n), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _deal(queues: list[list[np.ndarray]], s: np.ndarray, at: np.ndarray) -> None:
    """Append positions to their symbols' queues, order kept."""
    if not len(at):
        return
    symbols = s[at]
    order = np.argsort(symbols, kind="stable")
    at, symbols = at[order], symbols[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    first = symbols[np.concatenate([[0], cuts])]
    for symbol, part in zip(first.tolist(), np.split(at, cuts), strict=True):
        queues[symbol].append(part)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def induce(s: np.ndarray, sigma: int, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The suffix array that the seeds (leftmost S-type positions, in their order) induce.

    Buckets are scanned symbol by symbol; within one, all positions found so far move at once,
    and those that fall into the same bucket follow as the next round.
    """
    low: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    seeded: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    _deal(seeded, s, seeds)
    low[int(s[-1])].append(np.array([len(s) - 1]))
    larger: list[np.ndarray] = []
    for c in range(sigma):
        frontier, done = _join(low[c]), []
        while len(frontier):
            done.append(frontier)
            before = frontier[frontier > 0] - 1
            before = before[~small[before]]
            same = s[before] == c
            _deal(low, s, before[~same])
            frontier = before[same]
        larger.append(_join(done))
        ahead = _join(seeded[c])
        if len(ahead):
            _deal(low, s, ahead[ahead > 0] - 1)
    high: list[list[np.ndarray]] = [[] for _ in range(sigma)]
    smaller: list[np.ndarray] = [np.zeros(0, np.int64)] * sigma
    for c in range(sigma - 1, -1, -1):
        frontier, done = _join(high[c]), []
        while len(frontier):
            done.append(frontier)
            before = frontier[frontier > 0] - 1
            before = before[small[before]]
            same = s[before] == c
            _deal(high, s, before[~same])
            frontier = before[same]
        smaller[c] = _join(done)[::-1]
        back = larger[c][::-1]
        back = back[back > 0] - 1
        _deal(high, s, back[small[back]])
    return np.concatenate([x for c in range(sigma) for x in (larger[c], smaller[c])])


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number (a view; zeros follow the end)."""
    return np.ndarray(len(data), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


def _names(s: np.ndarray, ordered: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of the leftmost S-type substrings, in text order: equal substrings share one."""
    stop = np.append(starts[1:] + 1, len(s) + 1)  # the last one ends beyond the text
    length = np.zeros(len(s), np.int64)
    length[starts] = stop - starts
    a, b = ordered[:-1], ordered[1:]
    same = (length[a] == length[b]) & (a + length[a] <= len(s)) & (b + length[b] <= len(s))
    alive, k, word = np.flatnonzero(same), 0, _eights(s)
    while len(alive):
        left = length[a[alive]] - k
        apart = word[a[alive] + k] ^ word[b[alive] + k]
        apart <<= (8 * np.maximum(8 - left, 0)).astype(np.uint64)  # only bytes within the substrings count
        same[alive[apart != 0]] = False
        k += 8
        alive = alive[(apart == 0) & (left > 8)]
    rank = np.concatenate([[0], np.cumsum(~same)])
    name = np.zeros(len(s), np.int64)
    name[ordered] = rank
    return name[starts], int(rank[-1]) + 1


def _by_doubling(name: np.ndarray, reach: int | None) -> np.ndarray:
    """Order of the suffixes of ``name`` (at least by ``reach`` symbols): as many ranks as 63 bits hold are
    sorted at a time, so that each round multiplies the ranked length by two at least."""
    rank, count, k = name, int(name.max()) + 1, 1
    order = None
    while count < len(rank) and (reach is None or k < reach) and k < len(rank):
        bits = count.bit_length()
        key = rank + 1
        times = max(2, 63 // bits)
        for j in range(1, times):
            key = key << bits
            if j * k < len(rank):
                key[:-j * k] += rank[j * k:] + 1  # nothing, beyond the end, comes first
        order = np.argsort(key)
        key = key[order]
        ranked = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty_like(ranked)
        rank[order] = ranked
        count, k = int(ranked[-1]) + 1, k * times
    return np.argsort(rank, kind="stable") if order is None else order


def suffix_array(s: np.ndarray, sigma: int, depth: int | None = None) -> np.ndarray:
    """Positions of ``s`` (symbols 0..sigma-1, 256 at most) in suffix order; with ``depth``, by the first ``depth`` symbols at least.

    Leftmost S-type substrings are sorted by induction, named, and their order is found on the
    string of names: recursively, or by doubling once names are too many for buckets.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    s = s.astype(np.uint8, copy=False)
    small = classify(s)
    starts = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(starts) == 0:
        return induce(s, sigma, small, starts)
    ahead = np.zeros(n, bool)
    ahead[starts] = True
    first = induce(s, sigma, small, starts)
    name, count = _names(s, first[ahead[first]], starts)
    if count == len(starts):
        order = np.argsort(name)
    elif count <= 256 and len(name) >= 64 * count:
        order = suffix_array(name, count, depth)
    else:
        # Two names span two symbols at least each, so depth symbols need depth / 2 names.
        order = _by_doubling(name, None if depth is None else depth // 2 + 2)
    return induce(s, sigma, small, starts[order])


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Whether the suffix at each text position shares ``cap`` symbols with the one sorted just
    before it: the permuted common prefixes, cut at ``cap``, taken in text order by 8-byte steps."""
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    word = _eights(data)
    alive = np.flatnonzero((before >= 0) & (np.arange(n) + cap <= n) & (before + cap <= n))
    for at in sorted({*range(0, cap - 8, 8), cap - 8}):
        alive = alive[word[alive + at] == word[before[alive] + at]]
    shared = np.zeros(n, bool)
    shared[alive] = True
    return shared


def equal_windows(data: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group bounds): positions in suffix order, cut into groups that share their
    first ``cap`` bytes (positions without such company are groups of one)."""
    order = suffix_array(data, 256, cap)
    shared = common_prefixes(data, order, cap)
    return order, np.flatnonzero(~shared[order])
