"""A minimal perfect hash over distinct 128-bit keys: n keys get the numbers 0 to n - 1, in about 4 bits a key.

Each level hashes the keys that are left into a bit array of twice their number. A key that is alone in its place is settled there; the
others go on to the next level. The number of a key is the number of set bits before its place, over all levels. Everything is numpy on
whole arrays. Keys that were not built in get some number or none, so a caller compares a fingerprint stored under the number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gridspark.llm.textbytes import mix

SPREAD = 2
MAX_LEVELS = 64


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place in 0 .. size - 1 for each key (n, 2) of a level."""
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        h = mix(mix(keys[:, 0] + salt) ^ (keys[:, 1] + salt))
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


@dataclass(frozen=True)
class PerfectHash:
    sizes: np.ndarray  # bits of each level, whole words
    bits: np.ndarray  # words of all levels
    before: np.ndarray  # set bits before each word

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` is (n, 2) unsigned 64-bit and holds no key twice."""
        sizes, words = [], []
        while len(keys):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = -(-len(keys) * SPREAD // 64) * 64
            at = _places(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[at]]
        bits = np.concatenate(words) if words else np.zeros(0, "<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)[:-1]]) if bits.size else np.zeros(0, np.int64)
        return cls(np.array(sizes, np.int64), bits, before.astype("<u4"))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for keys that no level settles."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not left.size:
                break
            at = _places(keys[left], level, size)
            word, shift = base + (at >> 6), (at & 63).astype(np.uint64)
            found = (self.bits[word] >> shift) & np.uint64(1) == 1
            below = self.bits[word[found]] & ((np.uint64(1) << shift[found]) - np.uint64(1))
            out[left[found]] = self.before[word[found]] + np.bitwise_count(below)
            left = left[~found]
            base += size >> 6
        return out
