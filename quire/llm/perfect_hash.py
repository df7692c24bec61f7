"""Minimal perfect hashing of integer keys with numpy.

Keys are dealt into segments by a hash. In a segment, a key whose place in the
first level's bits no other key shares sets that bit; the rest go on to the
next level. A key's index is the number of set bits before its own, so n keys
get the indexes 0 to n - 1. Foreign keys get some index or none, so an index
holds only if the key stored there is the one asked for.
"""

from __future__ import annotations

import numpy as np

#: Places per key on each level.
ROOM = 2
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well spread unsigned hashes of 64-bit keys."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    return (mixed(keys, -1) % np.uint64(segments)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(words of 64 bits per level, all bits, keys by index) for distinct keys of one segment."""
    left, sizes, words, placed = np.asarray(keys, np.int64), [], [], []
    while len(left):
        size = -(-ROOM * len(left) // 64)
        at = (mixed(left, len(sizes)) % np.uint64(64 * size)).astype(np.int64)
        alone = np.bincount(at, minlength=64 * size) == 1
        here = alone[at]
        placed.append(left[here][np.argsort(at[here])])
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~here]
    return sizes, b"".join(words), np.concatenate(placed) if placed else left


class PerfectHash:
    """Looks keys up in the segments that it is given; others are not found."""

    def __init__(self, segments: int, rows: list[tuple[int, list[int], bytes, np.ndarray]]):
        """rows: (segment, words per level, bits, keys by index), as ``build`` returns them."""
        depth = max([len(r[1]) for r in rows], default=0)
        self.segments = segments
        self.size = np.zeros((segments, depth), np.int64)
        self.start = np.zeros((segments, depth), np.int64)
        at = 0
        for segment, sizes, _, _ in rows:
            for level, size in enumerate(sizes):
                self.size[segment, level], self.start[segment, level] = size, at
                at += size
        self.words = np.frombuffer(b"".join(r[2] for r in rows), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.keys = np.concatenate([np.asarray(r[3], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key among all keys in order of rows; -1 if it is none of them."""
        keys = np.asarray(keys, np.int64)
        out = np.full(len(keys), -1, np.int64)
        open_, segment = np.arange(len(keys)), segment_of(keys, self.segments)
        for level in range(self.size.shape[1]):
            size = self.size[segment[open_], level]
            open_, size = open_[size > 0], size[size > 0]
            if not len(open_):
                break
            at = (mixed(keys[open_], level) % (np.uint64(64) * size.astype(np.uint64))).astype(np.int64)
            word = self.start[segment[open_], level] + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)
