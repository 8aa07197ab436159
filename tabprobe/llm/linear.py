"""Sparse logistic regression with follow-the-regularised-leader updates, over hashed token n-grams.

Features and scores are computed inside tasks on whole texts; training runs on a bounded set of
labelled rows (the caller states the bound).
"""

from __future__ import annotations

import numpy as np

from tabprobe.llm import words

BITS = 18
# Length of a feature vector: long enough for confident scores after a few passes.
SCALE = 5.0


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, orders: tuple[int, ...] = (1, 2), fold: bool = False):
    """(bucket, weight, text offsets) of the hashed token n-grams of each text.

    Tokens are runs of letters and digits, or of other marks. Each distinct n-gram weighs
    1 + ln(count), and each text's weights are scaled to one length, so long and short texts
    compare. Besides, each run of letters gives its shape: all capitals, capitalised, the same as
    the run before it, and its length.
    """
    n = len(offsets) - 1
    raw = data
    if fold:
        data = words.FOLD[data]
    start, end, text = words.spans(data, offsets, words.CLASSES)
    h = words.hashes(data, start, end)
    parts, owners = [], []
    for order in orders:
        if len(h) >= order:
            acc = words.mix(h[:len(h) - order + 1] + np.uint64(order))
            for j in range(1, order):
                acc = words.mix(acc * np.uint64(0xD6E8FEB86659FD93) + h[j:len(h) - order + 1 + j])
            same = text[:len(h) - order + 1] == text[order - 1:]
            parts.append(acc[same])
            owners.append(text[:len(h) - order + 1][same])
    if len(h):
        upper = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw >= 65) & (raw <= 90), out=upper[1:])
        caps = upper[end] - upper[start]
        length = np.minimum(end - start, 40)
        shape = np.where(caps == 0, 0, np.where(caps * 2 >= length, np.where(length > 1, 2, 1), 1))
        again = np.zeros(len(h), np.int64)
        again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        parts.append(words.mix((shape * 2 + again + 1_000_003).astype(np.uint64)))
        owners.append(text)
        parts.append(words.mix((length + 2_000_003).astype(np.uint64)))
        owners.append(text)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(n + 1, np.int64)
    bucket = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)
    owner = np.concatenate(owners)
    key, count = np.unique(owner * (1 << bits) + bucket, return_counts=True)
    owner, bucket = key >> bits, key & ((1 << bits) - 1)
    weight = 1 + np.log(count)
    at = np.searchsorted(owner, np.arange(n + 1))
    norm = np.sqrt(np.bincount(owner, weights=weight * weight, minlength=n))
    return bucket, SCALE * weight / norm[owner], at


class Ftrl:
    """Per-coordinate follow-the-regularised-leader (proximal) for logistic loss."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.02):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int, seed: int = 0) -> np.ndarray:
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            for i in rng.permutation(len(rows)):
                self.update(*rows[i], labels[i])
        return self.weights()


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def with_bias(bucket, weight, size):
    """The row with the bias coordinate, the last one."""
    return np.append(bucket, size - 1), np.append(weight, 1.0)
