"""A hierarchical index over 64-bit fingerprints in Gray order, for searches within a Hamming distance.

Fingerprints are sorted by their rank in the reflected Gray code, so neighbours share many bits. The bits on which a
leaf's fingerprints agree are its mask and pattern; what a node's children have in common moves up into the node. A
search adds up a query's differences from patterns on the way down and drops a node, with all below it, once they are
too many.
"""

from __future__ import annotations

import numpy as np

#: Fingerprints of a leaf and children of a node.
LEAF, FAN = 4, 4
#: Query and node pairs that are held at a time.
HELD = 300_000
#: Queries of one step; a dense group is merged after each.
STEP = 512

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the reflected Gray code."""
    out = x.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        out = out ^ (out >> np.uint64(shift))
    return out


class GrayIndex:
    """Fingerprints (uint64, sorted by Gray rank) with the levels of nodes above them, the top one first."""

    def __init__(self, prints: np.ndarray) -> None:
        self.prints = prints
        starts = np.arange(0, len(prints), LEAF)
        first = np.repeat(prints[starts], np.diff(np.append(starts, len(prints))))
        mask = ~np.bitwise_or.reduceat(prints ^ first, starts)
        levels = [(prints[starts] & mask, mask)]
        while len(levels[-1][0]) > FAN:
            pattern, mask = levels[-1]
            starts = np.arange(0, len(pattern), FAN)
            first = np.repeat(pattern[starts], np.diff(np.append(starts, len(pattern))))
            shared = np.bitwise_and.reduceat(mask, starts) & ~np.bitwise_or.reduceat(pattern ^ first, starts)
            levels.append((pattern[starts] & shared, shared))
        self.levels = levels[::-1]
        # Of a leaf's fingerprints what its mask leaves; the last leaf is filled up.
        leaves = len(self.levels[-1][0])
        self.beyond = np.zeros(leaves * LEAF, np.uint64)
        self.beyond[: len(prints)] = prints & ~np.repeat(self.levels[-1][1], LEAF)[: len(prints)]
        self.beyond = self.beyond.reshape(leaves, LEAF)
        # A node keeps only the bits that its parent has not taken.
        self.own = [m if not i else m & ~np.repeat(self.levels[i - 1][1], FAN)[: len(m)] for i, (_, m) in enumerate(self.levels)]

    def search(self, queries: np.ndarray, most: int, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, position of a fingerprint) of all pairs that differ in at most `most` bits; with `after`, of each query only from that position on."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        top = len(self.levels[0][0])
        step = max(1, HELD // (top * LEAF))
        for at in range(0, len(queries), step):
            some = queries[at : at + step]
            q, node = np.repeat(np.arange(len(some)), top), np.tile(np.arange(top), len(some))
            low = np.zeros(len(some), np.int64) if after is None else after[at : at + step]
            self._down(some, low, q, node, np.zeros(len(q), np.uint8), 0, most, at, found)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _down(self, queries, low, q, node, differ, level, most, at, found) -> None:
        if len(q) * LEAF > HELD and len(q) > 1:
            half = len(q) // 2
            self._down(queries, low, q[:half], node[:half], differ[:half], level, most, at, found)
            self._down(queries, low, q[half:], node[half:], differ[half:], level, most, at, found)
            return
        pattern, own = self.levels[level][0], self.own[level]
        differ = differ + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
        span = LEAF * FAN ** (len(self.levels) - 1 - level)
        keep = np.flatnonzero((differ <= most) & ((node + 1) * span > low[q]))
        q, node, differ = q[keep], node[keep], differ[keep]
        if not len(q):
            return
        last = level + 1 == len(self.levels)
        width = LEAF if last else FAN
        limit = len(self.prints) if last else len(self.levels[level + 1][0])
        child = (node[:, None] * width + np.arange(width)).ravel()
        if not last:
            q, differ = np.repeat(q, width), np.repeat(differ, width)
            if child[-1] >= limit or node.max() + 1 == len(pattern):
                real = child < limit
                q, child, differ = q[real], child[real], differ[real]
            self._down(queries, low, q, child, differ, level + 1, most, at, found)
            return
        # What a leaf's pattern says is known; of its fingerprints the other bits are compared.
        rest = ((queries[q] & ~self.levels[level][1][node])[:, None] ^ self.beyond[node]).ravel()
        near = np.flatnonzero(np.bitwise_count(rest) <= np.repeat(most - differ, width))
        which, child = q[near // width], child[near]
        real = (child < limit) & (child >= low[which])
        found.append((which[real] + at, child[real]))


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each the position of a representative) after tying a to b."""
    while len(a):
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        labels = new
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]
    return labels


def linked(prints: np.ndarray, most: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest fingerprint that it is linked to, directly or not) of those linked at all.

    All links among `prints`, or only those between `prints` and `other`, count. Among `prints` each pair is met once, from
    its lower place. Members already known to be together are not compared any more: once a step has merged a large
    group, the index goes on without it, and what is outside searches an index of the group's own.
    """
    everything = prints if other is None else np.concatenate([prints, other])
    everything = np.unique(everything)
    if len(everything) < 2:
        return everything[:0], everything[:0]
    everything = everything[np.argsort(gray_rank(everything), kind="stable")]
    n = len(everything)
    labels, order = np.arange(n), np.arange(n)
    if other is not None:
        order = np.flatnonzero(np.isin(everything, prints))
    index, members, big, held = GrayIndex(everything), np.arange(n), -1, np.zeros(n, bool)
    for at in range(0, len(order), STEP):
        todo = order[at : at + STEP]
        if other is None:
            todo = todo[~held[todo]]
            q, hit = index.search(everything[todo], most, np.searchsorted(members, todo, side="right"))
        else:
            q, hit = index.search(everything[todo], most)
        a, b = todo[q], members[hit]
        new = labels[a] != labels[b]
        labels = merge(labels, a[new], b[new])
        if big >= 0:  # those outside the large group still need their links into it
            out = todo[labels[todo] != labels[big]]
            if len(out):
                q, hit = inner.search(everything[out], most)
                labels = merge(labels, out[q], inside[hit])
        size = np.bincount(labels, minlength=n)
        top = int(size.argmax()) if big < 0 else int(labels[big])
        if size[top] > (1024 if big < 0 else 1.5 * len(inside)):  # the group may grow, but is never exchanged for another
            big = top
            inside, members, held = np.flatnonzero(labels == top), np.flatnonzero(labels != top), labels == top
            inner = GrayIndex(everything[inside])
            if not len(members):
                break
            index = GrayIndex(everything[members])
    size = np.bincount(labels, minlength=n)
    many = size[labels] > 1
    if not many.any():
        return everything[:0], everything[:0]
    signed = everything.view(np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, labels, signed)
    return everything[many], least[labels][many].view(np.uint64)
