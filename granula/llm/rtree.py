"""R-tree over count vectors: pairs of token sets that may overlap enough, without looking at tokens.

Tokens are hashed into groups; a set's point counts its tokens per group. Two sets share at
most the sum over groups of the smaller count, so a tree node that keeps the largest count per
group and the smallest set size bounds what any set below it can share with another. Groups
are powers of two, so a finer point folds into a coarser one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 48
FANOUT = 8


def group_count(n: int) -> int:
    """Groups for a set of ``n`` tokens: one or two tokens each."""
    return 1 << max(3, (n // 2).bit_length())


def count_vector(tokens: np.ndarray, groups: int) -> bytes:
    """Counts by group, two to a byte; more groups are taken while a count does not fit into half a byte."""
    while True:
        counts = np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        if counts.max(initial=0) < 16:
            counts = counts.astype(np.uint8)
            return (counts[::2] | counts[1::2] << 4).tobytes()
        groups *= 2


def unpacked(vector: bytes) -> np.ndarray:
    pairs = np.frombuffer(vector, np.uint8)
    return np.stack([pairs & 15, pairs >> 4], 1).ravel()


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    return counts.reshape(-1, groups).sum(0, dtype=np.int32)


def enough(shared, sizes, percent: int):
    """Jaccard similarity of ``percent`` or more: 100 shared >= percent (sizes - shared)."""
    return (100 + percent) * shared >= percent * sizes


class RTree:
    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points.astype(np.uint8 if points.max(initial=0) < 256 else np.int32), sizes
        self.leaves = self._split(np.arange(len(sizes)))
        top = [points[x].max(0) for x in self.leaves]
        least = [sizes[x].min() for x in self.leaves]
        self.levels = [(np.array(top), np.array(least))]
        while len(self.levels[-1][1]) > FANOUT:
            top, least = self.levels[-1]
            at = np.arange(0, len(least), FANOUT)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)))

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Halve at the median of the coordinate (or size) that spreads most, down to leaves."""
        out, todo = [], [rows]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                out.append(own)
                continue
            p = self.points[own].astype(np.int32)
            axis = int(np.argmax(np.ptp(p, axis=0)))
            value = self.sizes[own] if np.ptp(self.sizes[own]) > 4 * np.ptp(p[:, axis]) else p[:, axis]
            order = np.argsort(value, kind="stable")
            half = len(own) // 2
            todo += [own[order[half:]], own[order[:half]]]
        return out

    def partners(self, leaf: int, percent: int) -> np.ndarray:
        """Leaves from this one on whose boxes may hold a partner of one of its points."""
        top, least = self.levels[0][0][leaf], self.levels[0][1][leaf]
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            box, low = self.levels[depth]
            at = at[enough(np.minimum(box[at], top).sum(1, dtype=np.int64), low[at] + least, percent)]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][1])]
        return at[at >= leaf]

    def pairs(self, percent: int, label) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j) whose bound reaches ``percent``; those that ``label()`` gives one label are skipped."""
        for leaf, own in enumerate(self.leaves):
            for other in self.partners(leaf, percent):
                with_ = self.leaves[other]
                labels = label()
                a, b = labels[own], labels[with_]
                differ = a[:, None] != b[None, :]
                if other == leaf:
                    differ = np.triu(differ, 1)
                if not differ.any():
                    continue
                bound = np.minimum(self.points[own][:, None, :], self.points[with_][None, :, :]).sum(2, dtype=np.int32)
                i, j = np.nonzero(differ & enough(bound, self.sizes[own][:, None] + self.sizes[with_][None, :], percent))
                if len(i):
                    order = np.argsort(-bound[i, j], kind="stable")
                    yield own[i[order]], with_[j[order]]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        self.up[max(i, j)] = min(i, j)

    def labels(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up
