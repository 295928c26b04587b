"""Vectorised text kernels that the corpus operators share.

Everything here works on Arrow string columns, a few megabytes of text at a
time, with numpy passes over the UTF-8 bytes; nothing loops over words.

A *word* is a maximal run of bytes other than the five ASCII white-space bytes
``\\t \\n \\f \\r`` and space.  A null text counts as an empty one: no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
RADIX = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
RADIX_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_IS_WORD = ~_SPACE
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = RADIX) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64; grown on demand and kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 4096), base, dtype=U64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@dataclass
class Words:
    """The words of some consecutive texts.

    ``data`` is the texts' bytes; ``base`` has each text's first byte (and the
    end); word ``i`` is ``data[start[i]:end[i]]``; ``first[d]:first[d + 1]`` are
    the words of text ``d``.
    """

    data: np.ndarray
    base: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """One 64-bit hash a word; ``data`` replaces the bytes (folded case)."""
        data = self.data if data is None else data
        if not len(self.start):
            return np.zeros(0, dtype=U64)
        size = self.end - self.start
        place = np.arange(len(data), dtype=np.int64)
        # the place of each byte in its word; bytes between words weigh nothing
        shift = np.zeros(len(data), dtype=np.int64)
        shift[self.start] = np.diff(self.start, prepend=0)
        place -= np.cumsum(shift)
        np.maximum(place, 0, out=place)
        weights = powers(int(max(size.max(), np.diff(self.start, append=len(data)).max(), self.start[0])) + 1)[place]
        weights *= _WEIGHT[data]
        sums = np.add.reduceat(weights, self.start)
        return mix(sums + size.astype(U64))


_WEIGHT = np.arange(1, 257, dtype=U64)
_WEIGHT[_SPACE] = 0


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=column.offset + n + 1)[column.offset :] if n else np.zeros(1, dtype=np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def words_of(data: np.ndarray, base: np.ndarray) -> Words:
    """Cut texts into words; a text's end always ends a word."""
    inside = _IS_WORD[data]
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return Words(data, base, none, none, np.zeros(len(base), dtype=np.int64))
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[base[:-1][base[:-1] < len(data)]] = False
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = base[1:] - 1
    after[ends[ends >= 0]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, base, start, end, np.searchsorted(start, base))


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES, change: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of ``batch`` with at most ``limit`` bytes of text, or one row, each; ``change`` is done to the bytes first."""
    column = batch.column(batch.schema.get_field_index(text))
    data, base = buffers(column)
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(base, base[at] + limit, side="right")) - 1)
        part = base[at : to + 1]
        inside = data[part[0] : part[-1]]
        yield batch.slice(at, to - at), words_of(inside if change is None else change(inside), part - part[0])
        at = to


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z folded; other alphabets keep their case."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with the case of A-Z and of two-byte Latin letters folded, and all but letters and digits as spaces."""
    out = _FOLD[data]
    accent = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[accent] += 32
    return out


_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes, at the run's first word.

    Runs that cross texts are there too; see :func:`window_ok`.
    """
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=U64)
    if n <= 8:
        out = words[:count].copy()
        for i in range(1, n):
            out *= RADIX
            out += words[i : i + count]
        return mix(out)
    sums = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(words * powers(len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(count, RADIX_INV))


def window_ok(first: np.ndarray, n: int) -> np.ndarray:
    """Whether the run of ``n`` words from each word stays in one text."""
    total = int(first[-1])
    ok = np.zeros(max(0, total - n + 1), dtype=bool)
    left = np.repeat(first[1:], np.diff(first))[: len(ok)]
    np.less_equal(np.arange(len(ok)) + n, left, out=ok)
    return ok


def char_offsets(data: np.ndarray) -> np.ndarray:
    """Characters before each byte (and before the end), for byte-to-character offsets."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
