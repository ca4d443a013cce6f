"""Vectorised word hashing over a batch of texts, shared by the duplicate finders."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(0, n - 1), base))), dtype=np.uint64)


class Words:
    """Words of a batch: hash, byte range in ``data`` and, for each text, the range of its words."""

    def __init__(self, texts: list[bytes | None]):
        self.data = b" ".join([t or b"" for t in texts]) + b" "
        raw = np.frombuffer(self.data, np.uint8)
        gap = (raw == 0x20) | (raw - np.uint8(0x09) < 5)
        edge = np.diff(np.concatenate(([True], gap)).view(np.int8))
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sizes = np.array([len(t or b"") for t in texts], np.int64) + 1
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        self.bounds = np.searchsorted(self.starts, cuts)
        if len(self.starts):
            lengths = self.ends - self.starts
            at = np.arange(len(raw)) - np.repeat(np.concatenate(([0], self.starts)), np.diff(np.concatenate(([0], self.starts, [len(raw)]))))
            table = powers(int(lengths.max()))
            np.minimum(at, len(table) - 1, out=at)
            value = raw.astype(np.uint64)
            value += np.uint64(1)
            value *= table[at]
            edges = np.stack((self.starts, self.ends), axis=1).ravel()  # sums of words and, between them, of gaps
            self.hashes = mix(np.add.reduceat(value, edges)[::2] + lengths.astype(np.uint64))
        else:
            self.hashes = np.zeros(0, np.uint64)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _times(a: np.uint64, b: np.uint64) -> np.uint64:
    return np.uint64(int(a) * int(b) & (1 << 64) - 1)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` word hashes (one for each start that has so many words after it)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, level, span, factor = np.zeros(n, np.uint64), 0, hashes, 1, BASE
    weight = np.uint64(1)
    left = size
    while left:
        if left & 1:
            out = out + weight * level[have : have + n]
            have += span
            weight = _times(weight, factor)
        left >>= 1
        if left:
            level = level[:-span] + factor * level[span:]
            factor = _times(factor, factor)
            span *= 2
    return mix(out)
