"""Suffix arrays, longest common prefixes and suffix trees of words, in memory that is a fixed multiple of the words.

``keys`` are equal where words of one document are equal and never for words of two documents; ``end`` is where each
word's document ends. The tree of a buffer is thus one tree for each document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from pinweave.llm.words import expand

#: Pairs of words that are looked at at once.
CHUNK = 1 << 20


def suffix_array(keys: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, rank of each) by prefix doubling; only suffixes not yet told apart are sorted again."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    group = keys[order]
    new = np.concatenate([[True], group[1:] != group[:-1]])[:n]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    open_ = order[~(new & np.concatenate([new[1:], [True]]))] if n else order
    k = 1
    while len(open_):
        after = open_ + k
        second = np.where(after < end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        first = rank[open_]
        key = first * (n + 1) + second
        sort = np.argsort(key, kind="stable")
        open_, key, first = open_[sort], key[sort], first[sort]
        at = np.arange(len(open_))
        base = np.maximum.accumulate(np.where(np.concatenate([[True], first[1:] != first[:-1]]), at, 0))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[open_] = first + np.maximum.accumulate(np.where(new, at, 0)) - base
        open_ = open_[~(new & np.concatenate([new[1:], [True]]))]
        k *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes, rank


def agreement(keys: np.ndarray, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """For each pair of places how many words agree from them on, forwards (step 1) or backwards (step -1).

    Windows of doubling size are compared, so the work goes with the words that agree.
    """
    n = len(keys)
    out = np.zeros(len(a), np.int64)
    room = n - np.maximum(a, b) if step > 0 else np.minimum(a, b) + 1
    open_ = np.flatnonzero(room > 0)
    width = 4
    while len(open_):
        still = []
        for lo in range(0, len(open_), max(1, CHUNK // width)):
            own = open_[lo : lo + max(1, CHUNK // width)]
            size = np.minimum(width, room[own] - out[own])
            run, off = expand(size)
            shift = step * (out[own][run] + off)
            same = keys[a[own][run] + shift] == keys[b[own][run] + shift]
            first = np.minimum.reduceat(np.where(same, size[run], off), np.cumsum(size) - size)
            out[own] += first
            still.append(own[(first == size) & (out[own] < room[own])])
        open_ = np.concatenate(still)
        width *= 2
    return out


def common_prefixes(keys: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Longest common prefix of each suffix with the one before it in order; -1 for the first.

    Words are compared only where the prefix is not one less than that of the word before; the sum of these prefixes is
    at most of order n log n, however much the text repeats.
    """
    n = len(keys)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    at = np.arange(n)
    new = (before <= 0) | (at == 0)
    new |= keys[at - 1] != keys[np.maximum(before - 1, -1)]
    start = np.flatnonzero(new & (before >= 0))
    prefix = np.zeros(n, np.int64)
    prefix[start] = agreement(keys, start, before[start], 1)
    last = np.maximum.accumulate(np.where(new, at, 0))
    prefix = np.maximum(prefix[last] - (at - last), 0)
    out = prefix[suffixes]
    out[:1] = -1
    return out


class Minima:
    """Nearest places to the left and right whose value is not larger, by a tree of minima over blocks."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(1, int(len(values)).bit_length())
        low = np.full(size, -1, np.int64)
        low[: len(values)] = values
        self.levels = [low]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2).min(axis=1))

    def nearest(self, at: np.ndarray, right: bool) -> np.ndarray:
        """Place 0 and the place after the last hold -1, so there always is one."""
        value, side = self.levels[0][at], int(right)
        node, height = at + (1 if right else -1), np.full(len(at), -1)
        open_ = np.arange(len(at))
        for k, low in enumerate(self.levels):
            # A node that is the near child of its parent is looked at together with its sibling, one level up.
            p = node[open_]
            own = (p & 1) == side
            hit = own & (low[p] <= value[open_])
            height[open_[hit]] = k
            p = np.where(own & ~hit, p + (1 if right else -1), p)
            node[open_[~hit]] = p[~hit] >> 1
            open_ = open_[~hit]
            if k + 2 == len(self.levels):
                break
        height[open_] = len(self.levels) - 1
        for k in range(len(self.levels) - 1, 0, -1):
            down = np.flatnonzero(height >= k)
            child = 2 * node[down] + (0 if right else 1)
            far = self.levels[k - 1][child] > value[down]
            node[down] = child + np.where(far, 1 if right else -1, 0)
        return node


@dataclass
class Tree:
    """Inner nodes below the root as ranges of suffixes in order, and their children.

    Node k holds suffixes ``lo[k]:hi[k]``, which agree in ``depth[k]`` words. Child c of node ``parent[c]`` holds
    ``left[c]:right[c]``; the largest child of each node is left out.
    """

    depth: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    parent: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def leaves(self, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(node, place in order) for every leaf of every child that is listed: each suffix log n times at most."""
        size = self.right - self.left
        total = np.cumsum(size)
        lo = 0
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + chunk, side="right")))
            run, off = expand(size[lo:hi])
            yield self.parent[lo:hi][run], self.left[lo:hi][run] + off
            lo = hi


def tree(prefix: np.ndarray) -> Tree:
    """The suffix tree of longest common prefixes (the first of them -1)."""
    at = np.flatnonzero(prefix > 0)
    minima = Minima(prefix)
    low, high = minima.nearest(at, False), minima.nearest(at, True)
    value = prefix[at]
    # Places of one node are chained to the first of them.
    opens = prefix[low] < value
    index = np.zeros(len(prefix), np.int64)
    index[at] = np.arange(len(at))
    node = np.where(opens, np.arange(len(at)), index[low])
    while True:
        up = node[node]
        if np.array_equal(up, node):
            break
        node = up
    end = np.zeros(len(at), np.int64)
    np.maximum.at(end, node, high)
    parent = np.concatenate([node, node[opens]])
    left, right = np.concatenate([at, low[opens]]), np.concatenate([high, at[opens]])
    order = np.lexsort((right - left, parent))
    largest = np.concatenate([parent[order][1:] != parent[order][:-1], [True]])[: len(order)]
    order = order[~largest]
    return Tree(value, low, end, parent[order], left[order], right[order])
