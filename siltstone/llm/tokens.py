"""Words and rolling fingerprints of Arrow text columns, computed on whole byte buffers.

A batch is cut into slices of whole documents; every function works on one slice, so memory follows the slice (or the
longest single document) and not the batch. Fingerprints are sums of ``table[byte] * p**i`` modulo 2**64, so any
stretch of bytes or words is one subtraction of prefix sums, then a finaliser mixes the bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_PRIME = 0x9E3779B97F4A7C13
_INVERSE = pow(_PRIME, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    _BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_TABLE = {False: _BYTES, True: _BYTES[_FOLD]}

_codes = np.arange(256)
#: Words `[^\x20\x09-\x0D]+`.
BLANK_SPLIT = ~np.isin(_codes, [0x20, 9, 10, 11, 12, 13])
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | ((_codes >= 0x41) & (_codes <= 0x5A)) | (_codes >= 0x80)

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_PRIME, _INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = U(1)
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values[:i] * p**index, for every i."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the stretches [start, end), the same wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(U))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, size: int = 1 << 20, most: int = 4000) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole rows, of about `size` bytes and `most` rows at most."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), i + most, n)
        yield i, j
        i = j


@dataclass
class Words:
    """The words of one slice: byte ranges in `data`, hashes, and the index of each row's first word (with an end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and fingerprint of each run of k words in a row. whole: a row of fewer, but not none, is one window."""
        n = self.counts
        per = np.maximum(n - k + 1, 0)
        length = np.full(len(n), k)
        if whole:
            short = (n > 0) & (n < k)
            per = np.where(short, 1, per)
            length = np.where(short, n, length)
        row = np.repeat(np.arange(len(n)), per)
        at = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per) + self.first[:-1][row]
        return row, at, stretch(prefix(self.hash), at, at + length[row])


def words(data: np.ndarray, offsets: np.ndarray, i: int, j: int, kind: np.ndarray, fold: bool) -> Words:
    """Words of rows i to j-1: maximal runs of bytes that `kind` marks; fold lower-cases A-Z first."""
    low = offsets[i]
    b = data[low : offsets[j]]
    bounds = offsets[i : j + 1] - low
    if not len(b):
        none = np.zeros(0, np.int64)
        return Words(b, none, none, np.zeros(0, U), np.zeros(j - i + 1, np.int64))
    inside = kind[b]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = bounds[:-1][bounds[:-1] < len(b)]
    begins[edge] = inside[edge]
    edge = bounds[1:][bounds[1:] > 0] - 1
    ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(b, start, end, stretch(prefix(_TABLE[fold][b]), start, end), np.searchsorted(start, bounds))


def covered(marks_from: np.ndarray, marks_to: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges [from, to)."""
    steps = np.bincount(marks_from, minlength=n + 1)[: n + 1] - np.bincount(marks_to, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0
