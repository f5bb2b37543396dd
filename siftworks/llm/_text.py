"""Vectorised words, word hashes and rolling word-window hashes over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 these bytes never occur
inside a longer character, so bytes and characters give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash

SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[list(SEPARATORS)] = False
#: Bytes of text that are handled at once; temporary arrays take about 60 bytes for each.
SLICE_BYTES = 1 << 20

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, element by element."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h = h * _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


#: Longer words are hashed one by one.
LONG = 256
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of the byte ranges data[starts[i]:ends[i]], eight bytes a step for all words at once.

    A step is a bijection of the state, so different words of the same length and at most 8 bytes never
    collide; others do with a chance of 2**-64. Words over LONG bytes take XXH3.
    """
    size = ends - starts
    h = mix(size.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64))
    if not len(size):
        return h
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))
    longest = int(size.max())
    if longest > LONG:
        for i in np.flatnonzero(size > LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    live = slice(None) if longest <= LONG else np.flatnonzero(size <= LONG)
    at, left = starts[live].astype(np.int64), size[live]
    while True:
        h[live] = mix(h[live] ^ (eight[at] & _LOW_BYTES[np.minimum(left, 8)]))
        go = np.flatnonzero(left > 8)
        if not len(go):
            return h
        live = go if isinstance(live, slice) else live[go]
        at, left = at[go] + 8, left[go] - 8


class Roller:
    """Polynomial prefix hash modulo 2**64 with an odd base, so that any range's hash is two look-ups.

    For ranges of a few dozen values that are hashes already, such as windows of words: over long ranges of
    few different values a power of two for a modulus has collisions (Thue-Morse), so words take word_hashes.
    """

    def __init__(self, seed: int) -> None:
        self.base = (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64 | 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up), 1 << 16)
        for name, base in (("up", self.base), ("down", self.inverse)):
            out = np.ones(n, dtype=np.uint64)
            out[1:] = _U(base)
            setattr(self, name, np.multiply.accumulate(out))

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[starts[i]:ends[i]] for each i."""
        self._powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.up[: len(values)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., for each range in turn."""
    out = np.ones(int(sizes.sum()), dtype=np.int64)
    if not len(out):
        return out
    keep = sizes > 0
    starts, sizes = starts[keep], sizes[keep]
    out[0] = starts[0]
    ends = np.cumsum(sizes)[:-1]
    out[ends] = starts[1:] - starts[:-1] - sizes[:-1] + 1
    return np.cumsum(out)


class Words:
    """Words of some texts: byte ranges in ``data``, and ``bounds``: text i has the words bounds[i]:bounds[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        if not len(data):
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
            self.bounds = np.zeros(len(offsets), dtype=np.int64)
            return
        inside = IS_WORD[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = offsets[offsets < len(data)]
        first[at] = inside[at]
        at = offsets[(offsets > 0)] - 1
        last[at] = inside[at]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def text_slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, offsets) of runs of rows with about ``most`` bytes; null counts as empty.

    A longer text makes a run of its own, whole.
    """
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    row0 = 0
    for chunk in chunks:
        chunk = chunk.cast(pa.large_binary())
        if chunk.null_count:
            chunk = chunk.fill_null(b"")
        n = len(chunk)
        if not n:
            continue
        _, offs, data = chunk.buffers()
        offsets = np.frombuffer(offs, dtype=np.int64)[chunk.offset : chunk.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
            yield row0 + i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j
        row0 += n


def trim() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, beside a full JVM heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own counsel
        pass


def trimmed(f: Callable) -> Callable:
    """For functions over batches or groups: trim after the last row."""

    @wraps(f)
    def over_batches(batches):
        yield from f(batches)
        trim()

    return over_batches
