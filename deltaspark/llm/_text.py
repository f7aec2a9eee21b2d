"""Vectorised text primitives shared by the operators of this subpackage.

Everything here works on slices of Arrow string batches: the texts of a slice
lie back to back in one byte buffer, and numpy handles all of them at once.
A slice is cut by bytes, so memory is bounded by SLICE_BYTES or by the longest
single text, whichever is larger.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 18

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One random 64-bit word for each byte value.
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)
_LOW = 1 << 12


class _Powers:
    """Powers of an odd number modulo 2**64, as products of a low and a high part: two small tables for any exponent."""

    def __init__(self, base: int):
        ones = np.full(_LOW, base, dtype=np.uint64)
        ones[0] = 1
        self.low, self.high = np.cumprod(ones), np.ones(1, dtype=np.uint64)
        self.step = np.uint64(pow(base, _LOW, 1 << 64))

    def _reach(self, n: int) -> None:
        if len(self.high) * _LOW < n:
            steps = np.full(2 * (n // _LOW + 1), self.step, dtype=np.uint64)
            steps[0] = 1
            self.high = np.cumprod(steps)

    def first(self, n: int) -> np.ndarray:
        self._reach(n)
        return (self.high[: n // _LOW + 1, None] * self.low[None, :]).ravel()[:n]

    def at(self, places: np.ndarray, most: int) -> np.ndarray:
        self._reach(most)
        return self.high[places // _LOW] * self.low[places % _LOW]


_powers, _inverses = _Powers(0x9E3779B97F4A7C15), _Powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def release() -> None:
    """Gives memory that Arrow and the C library hold for reuse back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(work: Callable) -> Callable:
    """A function of batches for mapInArrow that releases memory at its partition's end.

    Python workers are reused: what one stage holds on to would be missing in the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def byte_prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over bytes, for span_hash()."""
    return sequence_prefix(_TABLE[data])


def sequence_prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash over 64-bit values, for span_hash()."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers.first(len(values)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes, equal hash."""
    raw = (prefix[ends] - prefix[starts]) * _inverses.at(starts, len(prefix))
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive word hashes."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(len(words) - n + 1, dtype=np.uint64)
    c = 1
    for i in range(n):
        c = (c * 0xD1342543DE82EF95) % (1 << 64)
        out += words[i : len(words) - n + 1 + i] * np.uint64(c)
    return mix64(out)


class Slice:
    """Some consecutive rows of a batch: raw bytes, and where each text lies."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray, lower: bool):
        self.first, self.data, self.bounds = first, data, bounds
        self.n = len(bounds) - 1
        if lower:
            self.data = _LOWER[data]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words [^\\x20\\x09-\\x0D]+, and word counts before each text.

        A word never runs from one text into the next.
        """
        inside = np.zeros(len(self.data) + 2, dtype=bool)
        inside[1:-1] = ~_SPACE[self.data]
        begin = inside[1:-1] & ~inside[:-2]
        end = inside[1:-1] & ~inside[2:]
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        begin[cuts] |= inside[1:-1][cuts]
        end[cuts - 1] |= inside[1:-1][cuts - 1]
        starts = np.flatnonzero(begin)
        ends = np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)


def slices(texts: pa.Array, lower: bool = False, most: int | None = None) -> Iterator[Slice]:
    """Cut an Arrow string array into Slices of about `most` bytes; null texts count as empty."""
    most = most or SLICE_BYTES
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield Slice(i, raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], lower)
        i = j


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of equal neighbours."""
    if not len(keys):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return starts, np.r_[starts[1:], len(keys)]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated aranges [start, start + count)."""
    if not len(counts) or not counts.sum():
        return np.empty(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of its leftmost smallest value.

    Only the upper 44 bits of the values count. Blocks of prefix and suffix
    minima give every window in two looks, whatever the width.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    step = (1 << 20) - width  # places are kept in 20 bits, so long inputs go in pieces
    out = np.empty(n, dtype=np.int64)
    for a in range(0, n, step):
        b = min(n, a + step)
        part = values[a : b + width - 1]
        packed = (part & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(part), dtype=np.uint64)
        blocks = -(-len(part) // width)
        padded = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(part)] = packed
        grid = padded.reshape(blocks, width)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        best = np.minimum(right[: b - a], left[width - 1 : width - 1 + b - a])
        out[a:b] = (best & np.uint64(0xFFFFF)).astype(np.int64) + a
    return out
