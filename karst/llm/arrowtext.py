"""Whole texts of an Arrow batch as one byte buffer, with vectorised word boundaries and 64-bit content hashes.

Null texts are empty. Hashes are polynomial over a random byte table modulo 2^64, finished by a bijective mixer, so equal
contents have equal hashes on every machine. Such polynomials collide for some regular strings of 1024 bytes and more whatever
their base, so strings from LONG bytes are hashed by BLAKE2b.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
TABLE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = U(0x9E3779B97F4A7C15 | 3)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
COEF = _rng.integers(1, 2**64, 64, dtype=np.uint64) | U(1)

#: White space that ends a word: space and tab to carriage return.
_SPACE = np.zeros(256, np.uint8)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 1
WORD = 1 - _SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LONG = 512
SLICE = 1 << 20  # bytes of text handled at once; a longer text makes a slice of its own

_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        m = max(n, SLICE + (SLICE >> 2))
        _pow, _ipow = np.full(m, _BASE), np.full(m, _INVERSE)
        _pow[0] = _ipow[0] = 1
        _pow, _ipow = np.multiply.accumulate(_pow), np.multiply.accumulate(_ipow)
    return _pow, _ipow


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most `most` bytes of text, or one document."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(size)
        at = 0
        while at < n:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def release() -> None:
    """Give freed memory back at the end of a partition: a worker waits idle for its next task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class Texts:
    """buf: all texts, each followed by one space; off[i]: start of text i; end[i]: its end, without that space."""

    def __init__(self, column: pa.Array, lower: bool = False):
        kind = pa.large_binary()
        arr = pc.fill_null(pc.cast(column, pa.large_string()).cast(kind), pa.scalar(b"", kind))
        arr = pc.binary_join_element_wise(arr, pa.scalar(b"", kind), pa.scalar(b" ", kind))
        self.n = n = len(arr)
        _, offsets, data = arr.buffers()
        off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + n + 1]
        self.buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if n else np.zeros(0, np.uint8)
        self.off = off - off[0]
        self.end = self.off[1:] - 1
        if lower:
            self.buf = LOWER[self.buf]
        self._prefix = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            m = len(self.buf)
            pw, _ = powers(m + 1)
            self._prefix = np.zeros(m + 1, np.uint64)
            np.cumsum(TABLE[self.buf] * pw[:m], out=self._prefix[1:])
        return self._prefix

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte strings [start, stop)."""
        _, ip = powers(len(self.buf) + 1)
        h = mix((self.prefix[stop] - self.prefix[start]) * ip[start])
        for i in np.flatnonzero(stop - start >= LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.buf[start[i] : stop[i]], digest_size=8).digest(), "little")
        return h

    def split(self, table: np.ndarray = WORD) -> None:
        """Find words: ws, we are their bounds, wc[i] the number of words before text i, wd the text of each."""
        inside = table[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.ws, self.we = edge[0::2], edge[1::2]
        self.wc = np.searchsorted(self.ws, self.off)
        self.nw = np.diff(self.wc)
        self.wd = np.repeat(np.arange(self.n), self.nw)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.ws, self.we)


def gram_hashes(h: np.ndarray, wd: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word index and hash of each run of k words of one text."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(wd[:m] == wd[k - 1 :])
    g = np.zeros(len(at), np.uint64)
    for j in range(k):
        g += h[at + j] * COEF[j]
    return at, mix(g)


def covered(n: int, start: np.ndarray, width: int) -> np.ndarray:
    """Mask over n items: those inside any [s, s + width)."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, np.minimum(start + width, n), -1)
    return np.cumsum(d[:-1]) > 0


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty spans give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


class HashTable:
    """Distinct 64-bit keys to their order of arrival, looked up and filled a whole array at a time (linear probing)."""

    def __init__(self, bits: int = 16):
        self.order = np.zeros(1 << bits, np.uint64)
        self.n = 0
        self._make(bits)

    def _make(self, bits: int) -> None:
        self.mask = U((1 << bits) - 1)
        self.keys, self.at = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        if self.n:
            self._place(self.order[: self.n], np.arange(self.n, dtype=np.int32))

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = keys & self.mask
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.at[slot[won]] = values[won]
            keys, values, slot = keys[~won], values[~won], (slot[~won] + U(1)) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        slot = keys & self.mask
        there = self.keys[slot]
        hit = there == keys
        out[hit] = self.at[slot[hit]]
        left = np.flatnonzero(~hit & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + U(1)) & self.mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], slot[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """New distinct keys, none of which is there."""
        n = self.n + len(keys)
        while n > len(self.order):
            self.order = np.concatenate([self.order, np.zeros_like(self.order)])
        self.order[self.n : n] = keys
        if 2 * n > len(self.keys):
            self.n = n
            self._make(max(int(2 * n).bit_length(), int(self.mask).bit_length()) + 1)
        else:
            self._place(keys, np.arange(self.n, n, dtype=np.int32))
            self.n = n

    def keep_first(self, n: int) -> None:
        self.n = n
        self._make(int(self.mask).bit_length())
