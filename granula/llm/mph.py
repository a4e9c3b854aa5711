"""Minimal perfect hash over a fixed set of 128-bit keys, in whole-array steps.

Level by level, every key left marks one bit of an array of twice as many bits; keys alone on
their bit are placed, the others go on to the next level. A key's number is the rank of its
bit. About three bits per key; numbers are 0 .. n - 1, each used once. A key that was not in
the set gets some number or -1: callers compare fingerprints.
"""

from __future__ import annotations

import numpy as np

LEVELS = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (xor, shift, multiply)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def place(high: np.ndarray, low: np.ndarray, level: int, bits: int) -> np.ndarray:
    return mix(high + np.uint64(level) * (low | np.uint64(1))) % np.uint64(bits)


class Mph:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
        self.first = np.concatenate([[0], np.cumsum(sizes // 64)]).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray) -> "Mph":
        sizes, words = [], []
        for level in range(LEVELS):
            if not len(high):
                break
            bits = -(-2 * len(high) // 64) * 64
            at = place(high, low, level, bits)
            count = np.bincount(at.astype(np.int64), minlength=bits)
            words.append(np.packbits(count == 1, bitorder="little").view("<u8"))
            sizes.append(bits)
            left = count[at.astype(np.int64)] > 1
            high, low = high[left], low[left]
        if len(high):
            raise RuntimeError("two keys are equal")
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, "<u8"))

    def __call__(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        out = np.full(len(high), -1, np.int64)
        left = np.arange(len(high))
        for level, bits in enumerate(self.sizes):
            at = place(high[left], low[left], level, int(bits)).astype(np.int64)
            word = self.words[self.first[level] + at // 64]
            shift = (at % 64).astype(np.uint64)
            hit = (word >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[self.first[level] + at // 64] + below)[hit]
            left = left[~hit]
        return out
