"""Minimal perfect hashing of distinct 64-bit keys by levels of bit arrays, in NumPy."""

from __future__ import annotations

import numpy as np

_GAMMA = 1.5


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer; each seed gives another hash."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def build(keys: np.ndarray) -> bytes:
    """The function for distinct uint64 keys, in about four bits a key."""
    levels, rest = [], keys
    while len(rest):
        m = max(64, int(_GAMMA * len(rest)))
        at = (mix(rest, len(levels)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
        if len(levels) > 200:
            raise ValueError("keys are not distinct")
    head = np.array([len(levels), *map(len, levels)], np.int64).tobytes()
    return head + b"".join(np.packbits(x).tobytes() for x in levels)


class Function:
    """Maps each key that build() was given to its own index below their number."""

    def __init__(self, data: bytes):
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8).tolist()
        self.levels, at, base = [], 8 * (n + 1), 0
        for m in sizes:
            size = (m + 7) // 8
            bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=m).astype(bool)
            self.levels.append((bits, np.cumsum(bits, dtype=np.int64) - 1 + base))
            at, base = at + size, base + int(bits.sum())
        self.size = base

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Indexes of keys; an unknown key gets some index, or -1."""
        found = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, rank) in enumerate(self.levels):
            if not len(todo):
                break
            at = (mix(keys[todo], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            found[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
        return found
