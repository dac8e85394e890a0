"""Hashes of words and of word runs, for many texts at once."""

from __future__ import annotations

import numpy as np

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class WordHasher:
    """Hashes the words (runs of bytes that are not blank) of texts and the runs of ``width`` words."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, width: int) -> None:
        self.width = width
        self._byte = mixed(np.arange(1, 257, dtype=np.uint64))
        self._factor = mixed(np.arange(1001, 1001 + width, dtype=np.uint64)) | np.uint64(1)
        self._up = self._down = np.ones(0, dtype=np.uint64)

    def _reach(self, n: int) -> None:
        if len(self._up) < n:
            self._up = _powers(self.BASE, n)
            self._down = _powers(pow(self.BASE, -1, 1 << 64), n)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each text the sorted distinct hashes of its word runs. A text of fewer words than a run has is one run,
        a text without words has none."""
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        word = (data != 0x20) & ((data < 0x09) | (data > 0x0D))
        step = np.diff(word.astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self._reach(len(data) + 1)
        # A polynomial over the bytes, summed up once; a word's part is shifted back to its own start.
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._byte[data] * self._up[: len(data)], dtype=np.uint64)])
        hashes = mixed((total[ends] - total[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))
        lengths = np.array([len(t) + 1 for t in texts])
        limits = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        n, w = len(hashes), self.width
        if n >= w:
            runs = sum((hashes[k : n - w + 1 + k] * self._factor[k] for k in range(w)), np.zeros(n - w + 1, np.uint64))
            runs = mixed(runs + np.uint64(w))
        out = []
        for lo, hi in zip(limits[:-1].tolist(), limits[1:].tolist()):
            if hi - lo >= w:
                out.append(np.unique(runs[lo : hi - w + 1]))
            elif hi > lo:
                out.append(mixed(np.sum(hashes[lo:hi] * self._factor[: hi - lo], keepdims=True) + np.uint64(hi - lo)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


