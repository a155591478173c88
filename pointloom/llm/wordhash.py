"""Hashes of words and of word windows, by array operations over the bytes of a batch of texts.

Words are runs of bytes other than space and the control characters 9 to 13,
which is what splitting UTF-8 text at ASCII white space gives. A word's hash is a polynomial of
its bytes modulo 2**64 with random byte values, mixed; a window's is one of its word hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_LOW = _BYTE.copy()
_BYTE_LOW[65:91] = _BYTE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_P, _Q = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)
_Q_BACK = np.uint64(pow(int(_Q), -1, 1 << 64))

#: Bytes of texts worked on at once; a longer text is worked on alone.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of a factor, as many as were asked for."""

    def __init__(self, factor: np.uint64):
        self.factor, self.table = factor, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            size = 1 << (n - 1).bit_length()
            rest = np.full(size, self.factor, np.uint64)
            rest[0] = 1
            self.table = np.multiply.accumulate(rest)
        return self.table[:n]


_p, _q, _q_back = _Powers(_P), _Powers(_Q), _Powers(_Q_BACK)


@dataclass
class Words:
    """The words of consecutive texts: ``first`` row, words of row i in ``at[i]:at[i+1]``, hashes, and byte places in ``data``."""

    first: int
    at: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return o, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def words_of(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """Words of a string column without nulls, in slices of rows."""
    if not len(texts):
        return
    o, data = _buffers(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(o, o[i] + SLICE, "right")) - 1)
        yield _slice(i, o[i : j + 1] - o[i], data[o[i] : o[j]], lower)
        i = j


def _slice(first: int, o: np.ndarray, data: np.ndarray, lower: bool) -> Words:
    n = len(data)
    inside = ~_GAP[data]
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        cuts = o[1:-1][(o[1:-1] > 0) & (o[1:-1] < n)]  # a text's end ends a word
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    at = np.searchsorted(starts, o)
    if not len(starts):
        return Words(first, at, np.zeros(0, np.uint64), starts, ends, data)
    lengths = ends - starts
    where = np.flatnonzero(inside)
    begins = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(len(where)) - np.repeat(begins, lengths)
    values = (_BYTE_LOW if lower else _BYTE)[data[where]] * _p(int(lengths.max()))[place]
    return Words(first, at, mix(np.add.reduceat(values, begins) ^ lengths.astype(np.uint64)), starts, ends, data)


def digests(s: Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the BLAKE2 digest of each run of words ``begin`` to ``end`` (exclusive, not empty), joined by one space."""
    lengths = s.ends - s.starts
    at = np.concatenate(([0], np.cumsum(lengths + 1)))
    plain = np.full(at[-1], 32, np.uint8)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    plain[np.repeat(at[:-1], lengths) + place] = s.data[np.repeat(s.starts, lengths) + place]
    view = memoryview(plain)
    made = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(at[begin].tolist(), (at[end] - 1).tolist(), strict=True)])
    pairs = np.frombuffer(made, "<i8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k consecutive words (over all rows; the caller leaves out runs that cross rows)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    if k <= 8:
        q = _q(k)
        total = hashes[: n - k + 1] * q[0]
        for i in range(1, k):
            total = total + hashes[i : n - k + 1 + i] * q[i]
        return mix(total)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _q(n))))
    return mix((sums[k:] - sums[:-k]) * _q_back(n - k + 1))


def span_hashes(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of each run of words ``begin`` to ``end`` (exclusive), with its length."""
    n = len(hashes)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _q(max(n, 1))[:n])))
    return mix((sums[end] - sums[begin]) * _q_back(max(n, 1))[np.minimum(begin, max(n - 1, 0))] ^ (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x
