"""A bounded memory of ragged results by 64-bit key, for numpy batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np

from marketflow.llm.textarrays import mix, powers


class Memo:
    """Slots by the key's top bits; a later key takes an earlier one's slot. Results lie one after another in `flat`.
    Before a batch that finds more than `room` results there, all is forgotten: that costs time but changes nothing."""

    def __init__(self, bits: int = 19, room: int = 8_000_000):
        self.shift, self.room = np.uint64(64 - bits), room
        self.keys, self.begins, self.sizes = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.full(1 << bits, -1)
        self.flat, self.end = np.zeros(1 << 16, np.uint32), 0

    def gather(self, keys: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All keys' results, one after another, and their sizes. make(rows): the same for some rows of keys."""
        if self.end > self.room:
            self.sizes[:], self.end = -1, 0
        slots = (keys >> self.shift).astype(np.int64)
        begins, sizes = self.begins[slots], self.sizes[slots]
        missing = np.flatnonzero((self.keys[slots] != keys) | (sizes < 0))
        if len(missing):
            _, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            values, counts = make(missing[first])
            while self.end + len(values) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.end : self.end + len(values)] = values
            own = self.end + np.cumsum(counts) - counts
            self.end += len(values)
            begins[missing], sizes[missing] = own[back], counts[back]
            slot = slots[missing[first]]
            self.keys[slot], self.begins[slot], self.sizes[slot] = keys[missing[first]], own, counts
        return spread(self.flat, begins, sizes), sizes


def spread(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[b : b + n] for every b and n, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(total)]


def word_keys(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int, long: int = 256) -> np.ndarray:
    """A key for each span of some code points: a polynomial modulo 2 ** 64, and for spans of `long` code points or more a
    cryptographic hash, as long words can be made to have equal polynomials (from 1,024 letters on)."""
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(0x1F123BB5)) * powers(multiplier, len(points)), out=sums[1:])
    back = powers(pow(multiplier, -1, 1 << 64), len(points) + 1)
    keys = mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts >= long):
        keys[k] = int.from_bytes(hashlib.blake2b(points[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return keys
