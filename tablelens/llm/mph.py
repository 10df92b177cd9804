"""Minimal perfect hashing of 128-bit keys with numpy.

Each level hashes the keys that are left to a bit array twice their number; a
key alone on its bit is settled there, the others go on to the next level. A
key's slot is the number of set bits before its own, so n keys fill the slots
0..n-1 without gaps. Strangers either meet no set bit or land in some slot,
where the caller's stored fingerprint tells them apart.
"""

from __future__ import annotations

import numpy as np

_LEVELS = 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    return _mix(_mix(h1 + salt) ^ h2) % np.uint64(bits)


def build(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (h1, h2) -> bits per level, bit words of all levels, slot of each key."""
    left, sizes, words, where = np.arange(len(h1)), [], [], np.empty(len(h1), np.int64)
    base = 0
    while len(left):
        if len(sizes) == _LEVELS:
            raise ValueError("keys are not distinct")
        bits = 64 * (1 + len(left) // 32)
        at = _place(h1[left], h2[left], len(sizes), bits).astype(np.int64)
        alone = np.bincount(at, minlength=bits)[at] == 1
        where[left[alone]] = base + at[alone]
        bitmap = np.zeros(bits, np.uint8)
        bitmap[at[alone]] = 1
        words.append(np.packbits(bitmap, bitorder="little").view("<u8"))
        sizes.append(bits)
        base += bits
        left = left[~alone]
    flat = np.concatenate(words) if words else np.zeros(0, "<u8")
    return np.asarray(sizes, np.int64), flat, _rank(flat, where)


def _rank(words: np.ndarray, bit: np.ndarray) -> np.ndarray:
    ones = np.bitwise_count(words).astype(np.int64)
    before = np.cumsum(ones) - ones
    word, low = bit >> 6, (bit & 63).astype(np.uint64)
    return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << low) - np.uint64(1)))


def slots(sizes: np.ndarray, words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Slot of each probe, -1 where no level has its bit set."""
    bit = np.full(len(h1), -1, np.int64)
    left, base = np.arange(len(h1)), 0
    for level, bits in enumerate(sizes.tolist()):
        at = base + _place(h1[left], h2[left], level, bits).astype(np.int64)
        hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        bit[left[hit]] = at[hit]
        left, base = left[~hit], base + bits
    found = np.flatnonzero(bit >= 0)
    out = np.full(len(h1), -1, np.int64)
    if len(found):
        out[found] = _rank(words, bit[found])
    return out
