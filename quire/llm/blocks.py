"""Numpy primitives over blocks of texts.

A block is a run of documents of about ``BLOCK_BYTES`` of UTF-8, kept as one byte buffer with
document offsets.  Words are runs of bytes outside 0x20 and 0x09-0x0D, which for UTF-8 is the same
as code points outside that set.  All hashes are 64-bit, seeded by fixed constants, and equal on
every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _pow, _ipow
    if len(_pow) < n:
        m = max(n, 1 << 16)
        full = np.full(m, _BASE, np.uint64)
        full[0] = 1
        inv = np.full(m, _BASE_INV, np.uint64)
        inv[0] = 1
        _pow, _ipow = np.cumprod(full), np.cumprod(inv)
    return _pow[:n], _ipow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def prefix_sum(values: np.ndarray) -> np.ndarray:
    """out[i] = sum of values[:i]; keeps the dtype, so uint64 wraps."""
    out = np.zeros(len(values) + 1, values.dtype if values.dtype == np.uint64 else np.int64)
    np.cumsum(values, out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each byte span data[start:end], by content only."""
    pw, ipw = powers(len(data) + 1)
    sums = prefix_sum(_BYTE[data] * pw[: len(data)])
    return mix((sums[ends] - sums[starts]) * ipw[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def window_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive values; len(values)-k+1 of them, none if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pw, ipw = powers(len(values) + 1)
    sums = prefix_sum(values * pw[: len(values)])
    return mix((sums[k:] - sums[:n]) * ipw[:n])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: start, start+1, ... for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of flags between consecutive offsets."""
    return np.diff(prefix_sum(flags)[off])


class Block:
    """Texts of some documents with their words."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.off, self.n = off, len(off) - 1
        self.data = LOWER[data] if lower else data
        self.inside = inside = ~SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edges = off[(off > 0) & (off < len(data))]
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.word_off = np.searchsorted(self.start, off)
        self.n_words = np.diff(self.word_off)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        self._hash: np.ndarray | None = None

    @property
    def word_hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = span_hashes(self.data, self.start, self.end)
        return self._hash

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the first word, hash) of each k-word window inside one document."""
        h = window_hashes(self.word_hash, k)
        if not len(h):
            return np.zeros(0, np.int64), h
        at = np.flatnonzero(self.doc[: len(h)] == self.doc[k - 1 :])
        return at, h[at]

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def slices(off: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer document stands alone."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def blocks(texts: pa.Array | pa.ChunkedArray, lower: bool = False, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, Block) over a whole column."""
    data, off = buffers(texts)
    for lo, hi in slices(off, size):
        yield lo, hi, Block(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower)


def count_distinct_pairs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts (doc, value) pairs: (order, group number of each sorted item, group sizes)."""
    key = value ^ mix(doc.astype(np.uint64) + _U(0x5851F42D4C957F2D))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group) if len(k) else np.zeros(0, np.int64)
