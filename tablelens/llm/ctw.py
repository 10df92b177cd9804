"""Context-tree weighting over bytes, with numpy.

A byte is eight binary decisions; each decision (the bits before it are a node)
has a context tree over the bytes that went before, nearest first, down to
``depth`` of them. A node of the tree estimates its bit by Krichevsky and
Trofimov's rule, and its weighted probability is the even mixture of that
estimate and the product of its children's:

    Pw = 1/2 Pe + 1/2 prod(Pw of children),   Pw = Pe at the deepest level.

What a trained tree predicts is the mixture of the estimates on the path from
the root to the deepest context, each with the probability that the tree stops
there.

A gram is a number: the nearest context byte highest, then the farther ones,
the byte itself lowest. So all contexts of one depth are prefixes, and the
grams that share their nearest bytes form a subtree of their own.
"""

from __future__ import annotations

import math

import numpy as np

_HALF = math.log(0.5)
_SMALL = 4096
_LG_ONE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])  # lgamma(n + 1)
_LG_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL - 1) + 0.5))])  # lgamma(n + 1/2) - lgamma(1/2)
_LG_OF_HALF = math.lgamma(0.5)


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def _lgamma(n: np.ndarray, table: np.ndarray, shift: float, less: float) -> np.ndarray:
    small = n < _SMALL
    return np.where(small, table[np.where(small, n, 0)], _stirling(np.where(small, _SMALL, n) + shift) - less)


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of that many zeros and ones."""
    return (_lgamma(zeros, _LG_HALF, 0.5, _LG_OF_HALF) + _lgamma(ones, _LG_HALF, 0.5, _LG_OF_HALF)
            - _lgamma(zeros + ones, _LG_ONE, 1.0, 0.0))


def grams_of(body: bytes, depth: int) -> np.ndarray:
    """The gram of every byte of ``body``; before it stand ``depth`` line breaks."""
    b = np.frombuffer(b"\n" * depth + body, np.uint8).astype(np.int64)
    n = len(body)
    out = b[depth:].copy()
    for k in range(1, depth + 1):  # k-th context byte
        out |= b[depth - k:depth - k + n] << (8 * (depth + 1 - k))
    return out


class _Level:
    """One depth of a subtree: its distinct (context, byte) rows and, per bit, the nodes they fall into."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.nodes, self.zeros, self.ones = [], [], []
        for bit in range(8):
            prefix = keys >> (8 - bit)
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            first = np.flatnonzero(new)
            set_ = (keys >> (7 - bit)) & 1
            self.nodes.append(np.cumsum(new) - 1)
            self.ones.append(np.add.reduceat(n * set_, first))
            self.zeros.append(np.add.reduceat(n * (1 - set_), first))
        self.first = [np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1]) for x in self.nodes]


class Subtrees:
    """The trees from depth ``top`` down, for all grams of some contexts of that length (sorted, distinct).

    ``n`` may be 0: a gram to predict only.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> None:
        self.depth, self.top, self.grams, self.byte = depth, top, grams, grams & 255
        self.rows = [None] * (depth + 1)  # row of each gram at each depth
        self.levels: list[_Level | None] = [None] * (depth + 1)
        keys, counts, at = grams, n, np.arange(len(grams))
        up = [None] * (depth + 2)  # row at the next smaller depth of each row
        for d in range(depth, top - 1, -1):
            if d < depth:
                keys, back = np.unique((keys >> 16 << 8) | (keys & 255), return_inverse=True)
                counts = np.bincount(back, counts, len(keys)).astype(np.int64)
                up[d + 1], at = back, back[at]
            self.levels[d], self.rows[d] = _Level(keys, counts), at
        self.keys = keys  # (context, byte) rows at depth ``top``
        # The probability to stop, per depth, bit and node; log Pw at ``top``, per bit and node.
        self.stop = [[None] * 8 for _ in range(depth + 1)]
        self.weighted = [None] * 8
        for bit in range(8):
            below = None
            for d in range(depth, top - 1, -1):
                level = self.levels[d]
                pe = kt(level.zeros[bit], level.ones[bit])
                if d == depth:
                    pw, stop = pe, np.ones(len(pe))
                else:
                    child = self.levels[d + 1]
                    parent = level.nodes[bit][up[d + 1][child.first[bit]]]
                    pw = _HALF + np.logaddexp(pe, np.bincount(parent, below, len(pe)))
                    stop = np.exp(_HALF + pe - pw)
                self.stop[d][bit], below = stop, pw
            self.weighted[bit] = below

    def parts(self) -> list[np.ndarray]:
        """(context one byte shorter than ``top``, node, log Pw, zeros, ones) of the nodes at ``top``.
        A node is 2^bits + the bits before the decision."""
        level, out = self.levels[self.top], []
        for bit in range(8):
            keys = self.keys[level.first[bit]]
            out.append((keys >> 16, (1 << bit) + ((keys & 255) >> (8 - bit)), self.weighted[bit], level.zeros[bit], level.ones[bit]))
        return [np.concatenate(x) for x in zip(*out)]

    def log10(self, crown: Crown) -> np.ndarray:
        """log10 of the predicted probability of each gram's byte in its context."""
        total = np.zeros(len(self.byte))
        for bit in range(8):
            set_ = (self.byte >> (7 - bit)) & 1 == 1
            node = (1 << bit) + (self.byte >> (8 - bit))
            p, left = np.zeros(len(node)), np.ones(len(node))
            for d in range(self.top):
                context = self.grams >> (8 * (self.depth + 1 - d)) & (256**d - 1)
                stop = crown.stop[d][context, node]
                p += left * stop * crown.one[d][context, node]
                left *= 1 - stop
            for d in range(self.top, self.depth + 1):
                level = self.levels[d]
                one = (level.ones[bit] + 0.5) / (level.zeros[bit] + level.ones[bit] + 1.0)
                at = level.nodes[bit][self.rows[d]]
                stop = self.stop[d][bit][at]
                p += left * stop * one[at]
                left *= 1 - stop
            total += np.log10(np.where(set_, p, 1 - p))
        return total


class Crown:
    """The trees above depth ``top``, from sums over all subtrees: at most 256^(top-1) * 255 nodes."""

    def __init__(self, top: int, context, node, weighted, zeros, ones) -> None:
        self.stop, self.one = ([np.full((256**d, 256), 0.5) for d in range(top)] for _ in range(2))
        context, node = np.asarray(context, np.int64), np.asarray(node, np.int64)
        weighted, zeros, ones = np.asarray(weighted, float), np.asarray(zeros, np.int64), np.asarray(ones, np.int64)
        for d in range(top - 1, -1, -1):
            pe = kt(zeros, ones)
            pw = _HALF + np.logaddexp(pe, weighted)
            self.stop[d][context, node] = np.exp(_HALF + pe - pw)
            self.one[d][context, node] = (ones + 0.5) / (zeros + ones + 1.0)
            above, at = np.unique((context >> 8 << 8) | node if d else node, return_inverse=True)
            weighted = np.bincount(at, pw, len(above))
            zeros, ones = (np.bincount(at, x, len(above)).astype(np.int64) for x in (zeros, ones))
            context, node = above >> 8, above & 255


class Lookup:
    """Numbers -> values by open addressing; ``None`` keys are not allowed, a miss is -1."""

    def __init__(self, keys: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys, self.place = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.place[at] < 0
            self.place[at[free]] = left[free]  # of several the last one stays
            mine = self.place[at] == left
            self.keys[at[mine]] = keys[left[mine]]
            left, at = left[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.place[at], -1)
        left = np.flatnonzero((got != keys) & (got >= 0))
        while len(left):
            at_left = (at[left] + 1) & ((1 << self.bits) - 1)
            at[left] = at_left
            got = self.keys[at_left]
            hit = got == keys[left]
            out[left[hit]] = self.place[at_left[hit]]
            left = left[~hit & (got >= 0)]
        return out
