"""Minimal perfect hashing of 64-bit keys in numpy: levels of bit arrays with ranks.

At each level every key still without a slot picks a bit; bits picked once are kept, the keys of the others go on
to the next level. A key's slot is the number of kept bits before its own. About three bits a key are stored;
a lookup reads a bounded number of words. Absent keys get a slot or -1, so callers store fingerprints.
"""

from __future__ import annotations

import struct

import numpy as np

from quern.llm.common import U64, mix64

SPREAD = 2.0
MAX_LEVELS = 64


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray, count: int) -> None:
        self.sizes, self.words, self.count = sizes, words, count
        self.bases = np.concatenate(([0], np.cumsum(sizes // 64)))[:-1]
        ones = np.bitwise_count(words).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        scattered = mix64(keys + U64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        return ((scattered >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys (fewer than 2**31); ValueError if one repeats."""
        rest, sizes, parts = np.asarray(keys, dtype=U64), [], []
        while len(rest):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("a key repeats")
            size = -(-int(SPREAD * len(rest)) // 64) * 64
            at = cls._place(rest, len(sizes), size)
            picked = np.bincount(at, minlength=size)
            parts.append(np.packbits(picked == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[picked[at] > 1]
        words = np.concatenate(parts) if parts else np.zeros(0, dtype="<u8")
        return cls(np.array(sizes, dtype=np.int64), words, len(keys))

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys; -1 for some keys that were not given to ``build``."""
        keys = np.asarray(keys, dtype=U64)
        slots, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self._place(keys[open_], level, size)
            word = self.bases[level] + (at >> 6)
            bit = U64(1) << (at & 63).astype(U64)
            hit = (self.words[word] & bit) != 0
            below = np.bitwise_count(self.words[word[hit]] & (bit[hit] - U64(1)))
            slots[open_[hit]] = self.ranks[word[hit]] + below
            open_ = open_[~hit]
            if not len(open_):
                break
        return slots

    def to_bytes(self) -> bytes:
        return struct.pack("<QQ", self.count, len(self.sizes)) + self.sizes.astype("<i8").tobytes() + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes | memoryview) -> PerfectHash:
        count, levels = struct.unpack_from("<QQ", raw)
        sizes = np.frombuffer(raw, dtype="<i8", count=levels, offset=16)
        return cls(sizes, np.frombuffer(raw, dtype="<u8", count=int(sizes.sum()) // 64, offset=16 + 8 * levels), count)
