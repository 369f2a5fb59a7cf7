"""Minimal perfect hashing over 64-bit keys, in numpy.

Levels of bit arrays: a key that is alone at its position in a level is placed there, the others go
on to the next level. A key's index is the number of set bits before its own, over all levels.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA, MAX_LEVELS = 2.0, 48


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    """A finaliser of the SplitMix64 kind, seeded by the level."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class Mph:
    """``index(keys)`` maps the n keys it was built on one-to-one onto 0..n-1.

    Any other key gets some index or -1: the caller compares a stored fingerprint.
    """

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        ones = [0]
        self.ranks = []
        for bits in levels:
            per_word = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
            self.ranks.append(ones[0] + np.concatenate([[0], np.cumsum(per_word)[:-1]]))
            ones[0] += int(per_word.sum())
        self.n = ones[0]

    @classmethod
    def build(cls, keys: np.ndarray) -> Mph:
        """keys: distinct uint64 values."""
        left, levels = np.asarray(keys, dtype=np.uint64), []
        while len(left):
            if len(levels) == MAX_LEVELS:
                raise ValueError("the keys of a minimal perfect hash must be distinct")
            size = max(64, int(np.ceil(len(left) * GAMMA / 64)) * 64)
            at = (_mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = _mix(keys[todo], level) % np.uint64(len(bits) * 8)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            words = bits.view(np.uint64)[word]
            hit = (words >> bit) & np.uint64(1) == 1
            below = words[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.ranks[level][word[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.levels)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Mph:
        with np.load(io.BytesIO(data)) as z:
            return cls([z[k] for k in z.files])
