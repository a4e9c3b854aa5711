"""Hashes of runs of words, as whole arrays over the concatenated words of many documents."""

from __future__ import annotations

import numpy as np
import xxhash

from .mph import mix


class WordHash(dict):
    """64-bit hash by word (bytes), remembered."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(texts: list, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in a row, and how many each text has."""
    known, flat, counts = WordHash(), [], []
    for t in texts:
        data = (t or "").encode()
        own = (data.lower() if lower else data).split()
        flat.append(np.fromiter(map(known.__getitem__, own), np.uint64, len(own)))
        counts.append(len(own))
    return np.concatenate(flat) if flat else np.empty(0, np.uint64), np.array(counts, np.int64)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, from runs of powers of two."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    powers, p = {1: h}, 1
    while 2 * p <= length:
        powers[2 * p] = joined(powers[p][:-p], powers[p][p:])
        p *= 2
    out, at = None, 0
    for p in sorted(powers, reverse=True):
        if length & p:
            part = powers[p][at:at + n]
            out = part if out is None else joined(out, part)
            at += p
    return out


def places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every word: its position in its text, and how many words follow it there (itself included)."""
    starts = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) - np.repeat(starts, counts)
    return at, np.repeat(counts, counts) - at
