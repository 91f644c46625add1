"""Words of byte columns as 64-bit hashes, a whole Arrow batch at a time.

A word's hash is the sum of one random value for each byte times one random odd factor for
each place, put through a mixing function. Two different words meet with a chance of about
2**-60; the operators that decide on words say where they compare the bytes as well.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240229))
_VALUES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = _SEED.integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_HIGH = _SEED.integers(1, 2**63, 1 << 12, dtype=np.uint64) | np.uint64(1)
_HIGH[0] = 1
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at a time; the scratch arrays are eight times as large.
SEGMENT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordRule:
    """Which bytes part words; A-Z count as a-z."""

    def __init__(self, separators: bytes):
        self.sep = np.zeros(256, bool)
        self.sep[list(separators)] = True
        lower = np.arange(256)
        lower[65:91] += 32
        self.lower = lower.astype(np.uint8)
        self.value = _VALUES[lower]
        self.value[self.sep] = 0

    def spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash and first byte of every word of the texts data[at[i]:at[i+1]], and the first word of each text."""
        hashes, starts = [], []
        lo, size = 0, len(data)
        while lo < size:
            hi = min(size, lo + SEGMENT)
            if hi < size:
                hi = self._cut(data, at, hi)
            h, s = self._segment(data[lo:hi], at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo)
            hashes.append(h)
            starts.append(s + lo)
            lo = hi
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        s = np.concatenate(starts) if starts else np.empty(0, np.int64)
        return h, s, np.searchsorted(s, at)

    def _cut(self, data: np.ndarray, at: np.ndarray, near: int) -> int:
        """The first place from `near` on where no word is cut."""
        edge = int(at[np.searchsorted(at, near)])
        step, lo = 1 << 12, near
        while lo < edge:
            found = np.flatnonzero(self.sep[data[lo : min(edge, lo + step)]])
            if len(found):
                return lo + int(found[0])
            lo, step = lo + step, step * 4
        return edge

    def _segment(self, part: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = ~self.sep[part]
        first = inside.copy()
        first[1:] &= self.sep[part[:-1]]
        edges = edges[edges < len(part)]
        first[edges] = inside[edges]
        start = np.flatnonzero(first)
        if not len(start):
            return np.empty(0, np.uint64), start
        place = np.arange(len(part))
        place[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(part))))
        term = self.value[part] * _LOW[place & 4095]
        if len(part) > 4096 and int(np.diff(np.append(start, len(part))).max()) > 4096:
            term *= _HIGH[(place >> 12) & 4095]
        return mix(np.add.reduceat(term, start)), start


#: Words between blanks, as the shingle operators take them.
BLANKS = WordRule(bytes([0x20, *range(0x09, 0x0E)]))
#: Words of 0-9, a-z and all bytes from 0x80 on.
ALNUM = WordRule(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_K = _SEED.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a text of fewer words is one shingle, none gives none."""
    if len(hashes) >= k:
        every = sum((hashes[j : len(hashes) - k + 1 + j] * _K[j] for j in range(1, k)), hashes[: len(hashes) - k + 1] * _K[0])
        every = mix(every)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(every[lo : hi - k + 1]))
        elif hi > lo:
            whole = (hashes[lo:hi] * _K[: hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
            out.append(mix(np.array([whole ^ _B])))
        else:
            out.append(np.empty(0, np.uint64))
    return out
