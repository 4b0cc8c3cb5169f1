"""Minimal perfect hashing of distinct 64-bit keys, in numpy.

Level by level, the keys left are hashed to ``GAMMA`` cells a key; a cell that
exactly one key hits takes that key, the others go on to the next level. A key's
slot is the number of taken cells before its own, so n keys have the slots 0 to n - 1.
The keys are stored by slot, so that a foreign key is told apart for certain.
"""

from __future__ import annotations

import numpy as np

GAMMA = 2.0
#: Keys left after so many levels are looked up in a sorted list.
LEVELS = 48


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class PerfectHash:
    """Slots of a fixed set of distinct keys."""

    def __init__(self, keys: np.ndarray):
        left, self.levels, base = np.asarray(keys, np.int64), [], 0
        while len(left) and len(self.levels) < LEVELS:
            size = -(-max(64, int(GAMMA * len(left))) // 64) * 64
            cell = (mix(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(cell, minlength=size)
            alone = hits[cell] == 1
            words = np.packbits(hits == 1, bitorder="little").view("<u8")
            before = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
            self.levels.append((size, words, before[:-1]))
            base, left = int(before[-1]), left[~alone]
        self.base, self.rest = base, np.sort(left)
        self.keys = np.zeros(len(keys), np.int64)
        self.keys[self._places(np.asarray(keys, np.int64))] = keys

    def _places(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (size, words, before) in enumerate(self.levels):
            if not len(todo):
                return out
            cell = (mix(keys[todo], seed) % np.uint64(size)).astype(np.int64)
            word, bit = words[cell >> 6], (cell & 63).astype(np.uint64)
            taken = (word >> bit & np.uint64(1)).astype(bool)
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[taken]] = (before[cell >> 6] + under)[taken]
            todo = todo[~taken]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            out[todo] = np.where(self.rest[at] == keys[todo], self.base + at, -1)
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that is not in the set."""
        places = self._places(keys)
        if not len(self.keys):
            return places
        return np.where((places >= 0) & (self.keys[places] == keys), places, -1)

    def dump(self, out) -> None:
        np.save(out, np.array([self.base, len(self.levels)], np.int64))
        for size, words, before in self.levels:
            np.save(out, np.array([size], np.int64))
            np.save(out, words)
            np.save(out, before)
        np.save(out, self.rest)
        np.save(out, self.keys)

    @staticmethod
    def load(source) -> PerfectHash:
        self = PerfectHash.__new__(PerfectHash)
        self.base, n = map(int, np.load(source))
        self.levels = [(int(np.load(source)[0]), np.load(source), np.load(source)) for _ in range(n)]
        self.rest, self.keys = np.load(source), np.load(source)
        return self
