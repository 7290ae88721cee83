"""Numpy views of Arrow text columns: bytes and offsets, words, and polynomial hashes of any span.

Work goes slice by slice, so memory follows the slice (or one long text), not the batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
PRIME = (1 << 61) - 1
_PRIME_INVERSE = pow(BASE % PRIME, -1, PRIME)
_PRIME, _LOW, _HALF = np.uint64(PRIME), np.uint64((1 << 31) - 1), np.uint64(31)
_prime_powers: dict[int, np.ndarray] = {}
_rng = np.random.default_rng(20240229)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod 2 ** 64; kept, and doubled when too short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length() if n > 1 else 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _fold(x: np.ndarray) -> np.ndarray:
    """x mod PRIME."""
    x = (x & _PRIME) + (x >> np.uint64(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b mod PRIME, for values below PRIME, in parts of 31 bits."""
    a1, a0, b1, b0 = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    middle = a0 * b1 + a1 * b0
    return _fold(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & np.uint64(0x3FFFFFFF)) << _HALF) + a0 * b0)


def prime_powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) mod PRIME; kept, and doubled when too short."""
    have = _prime_powers.get(base, np.ones(1, np.uint64))
    while len(have) < max(n, 1 << 16):
        have = np.concatenate([have, _times(have, np.uint64(pow(base, len(have), PRIME)))])
    _prime_powers[base] = have
    return have[:n]


class Hashes:
    """Prefix sums over some bytes; of() hashes spans of them.

    A span's hash is the sum of (byte + 1) * BASE ** place modulo the prime 2 ** 61 - 1, brought back to place 0 and mixed with
    its length. No power of two is the modulus: there the Thue-Morse words of 1,024 letters collide for every base. The
    sums are kept as two parts of 31 bits; spans too long for them are hashed by themselves.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data = data
        x, p = data.astype(np.uint64) + np.uint64(1), prime_powers(BASE % PRIME, n)
        self.low, self.high = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        np.cumsum(x * (p & _LOW), out=self.low[1:])
        np.cumsum(x * (p >> _HALF), out=self.high[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high = _fold(self.high[end] - self.high[start])
        total = _fold(((high & np.uint64(0x3FFFFFFF)) << _HALF) + (high >> np.uint64(30)) + _fold(self.low[end] - self.low[start]))
        total = _times(total, prime_powers(_PRIME_INVERSE, len(self.data) + 1)[start])
        out = mix(total ^ mix((end - start).astype(np.uint64)))
        for k in np.flatnonzero(end - start >= 1 << 23):
            out[k] = int.from_bytes(hashlib.blake2b(self.data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
        return out

    def grams(self, width: int) -> np.ndarray:
        """Hashes of all spans of one small width, by another polynomial, modulo 2 ** 64."""
        n = len(self.data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[self.data] * powers(BASE, n), out=sums[1:])
        n = max(0, n + 1 - width)
        return mix((sums[width : width + n] - sums[:n]) * powers(_INVERSE, n))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and n + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of at most `rows` rows and of about limit bytes each, or one row alone where it is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n, i + rows)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (n + 1 numbers); offsets start at 0."""
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[:1], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    after[-1:], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words has its whole sequence as one, a text
    without words none."""
    data, offsets = raw(column)
    for i, j in slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if lower:
            part = LOWER[part]
        starts, ends, first = word_spans(part, at)
        words = Hashes(part).of(starts, ends)
        n = np.maximum(len(words) - width + 1, 0)
        grams = np.zeros(n, np.uint64)
        for k in range(width):
            grams = mix(grams * np.uint64(0x9FB21C651E98DF25) + words[k : k + n])
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                yield np.unique(grams[a : b - width + 1])
            elif b > a:
                short = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    short = mix(short * np.uint64(0x9FB21C651E98DF25) + w)
                yield mix(short + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
