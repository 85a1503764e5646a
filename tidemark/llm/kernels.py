"""Vectorised work on the UTF-8 bytes of many texts at once, for use inside Arrow batches.

A slice is a stretch of one Arrow column: the bytes of its texts back to back and their offsets.
Words are runs of bytes of a class; as every separator is an ASCII byte, no decoding is needed.
Hashes are polynomials modulo 2**64 over random byte values, finished by a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def _keep(separators) -> np.ndarray:
    keep = np.ones(256, bool)
    keep[list(separators)] = False
    return keep


# Words of the contracts: not white space; and letters or digits of ASCII plus all that is not ASCII.
NOT_SPACE = _keep([0x20, *range(0x09, 0x0E)])
LETTERS_DIGITS = _keep([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base and of its inverse; grown when a longer text comes."""
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                step = np.uint64(pow(base, done, 2**64))
                table[done : 2 * done] = table[:done] * step
                done *= 2
            _tables[k] = table
    return _tables


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values are far apart."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte span; equal strings have equal hashes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts])


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, one for each start (document ends are not looked at)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(_STEP)
        h += words[j : j + n]
    return mixed(h)


@dataclass
class Slice:
    """Texts lo to hi of a batch: their bytes back to back, and where each begins."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self):
        return self.hi - self.lo


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the number of all words

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(column, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a text column so that a slice has about ``limit`` bytes, or one longer text. Null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, content = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    content = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(column))
        yield Slice(lo, hi, content[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    inside = keep[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offsets))


def windows_inside(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each window start of a shingle array of length n: it does not cross a text's end."""
    ok = np.ones(max(n, 0), bool)
    for b in first[1:-1]:
        ok[max(0, b - k + 1) : b] = False
    return ok


class WordTable:
    """An open-addressing map from 64-bit hashes to numbers given in order of arrival."""

    def __init__(self, bits: int = 16):
        self.size = 0
        self._make(bits)

    def _make(self, bits: int):
        self.bits = bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 where it is unknown."""
        mask = np.uint64((1 << self.bits) - 1)
        slots = (keys & mask).astype(np.int64)
        found = self.values[slots]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slots] != keys))
        while len(wrong):
            slots[wrong] = (slots[wrong] + 1) & int(mask)
            found[wrong] = self.values[slots[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slots[wrong]] != keys[wrong])]
        return found

    def add(self, keys: np.ndarray) -> None:
        """Give new numbers to distinct keys that are not in the table yet."""
        if 3 * (self.size + len(keys)) > 2 * len(self.keys):
            old = self.values >= 0
            order = np.argsort(self.values[old])
            kept = self.keys[old][order]
            self._make(max(self.bits + 1, (3 * (self.size + len(keys))).bit_length()))
            self._place(kept, np.arange(len(kept)))
        self._place(keys, np.arange(self.size, self.size + len(keys)))
        self.size += len(keys)

    def _place(self, keys, numbers):
        mask = (1 << self.bits) - 1
        slots = (keys & np.uint64(mask)).astype(np.int64)
        while len(keys):
            free = self.values[slots] < 0
            self.values[slots[free]] = numbers[free]
            self.keys[slots[free]] = keys[free]
            lost = self.values[slots] != numbers
            keys, numbers, slots = keys[lost], numbers[lost], (slots[lost] + 1) & mask


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
