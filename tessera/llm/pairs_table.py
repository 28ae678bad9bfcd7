"""A hash table of id pairs on numpy arrays, looked up for whole arrays at once."""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int32).max


class PairTable:
    """Open addressing with linear probing; a key is left * width + right."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, width: int):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.width, self.shift, self.mask = width, np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while left.size:
            free = self.keys[slot[left]] == -1
            place, first = np.unique(slot[left[free]], return_index=True)
            put = left[free][first]
            self.keys[place], self.values[place] = keys[put], values[put]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The value of each pair, NONE where the table lacks it."""
        keys = left.astype(np.int64) * self.width + right
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while open_.size:
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there != -1)]
        return found
