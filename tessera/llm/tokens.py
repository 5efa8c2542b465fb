"""Words of many texts at once, as NumPy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r, which are the bytes 32 and 9 to 13."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import as_strided

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20240229))
_KEYS = _RNG.integers(0, 2**64, 4, dtype=np.uint64)
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
LONG = 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    start: np.ndarray  # byte offsets
    end: np.ndarray
    ptr: np.ndarray  # words of text i are ptr[i]:ptr[i + 1]


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    _, off = buffer(column)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def split(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = IS_SPACE) -> Words:
    """gap: by byte, whether it stands between words."""
    inside = ~gap[buf]
    n = len(buf)
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]  # a text ends here and another begins
    start[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(s, e, np.searchsorted(s, off))


def fold(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _FOLD[buf]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(buf: np.ndarray, w: Words, lane: int = 0) -> np.ndarray:
    """64 bits per word, from its bytes, eight at a time, each step through `mix`; lanes are independent, two of them make
    128 bits. Words of more than `LONG` bytes, of which there are few, are hashed one by one."""
    size = w.end - w.start
    with np.errstate(over="ignore"):
        h = mix(size.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + _KEYS[lane])
        if not len(size):
            return h
        at = as_strided(np.concatenate([buf, np.zeros(8, np.uint8)]), (len(buf) + 1, 8), (1, 1), writeable=False)
        own, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
        while len(own):
            left = size[own] - done
            x = np.ascontiguousarray(at[w.start[own] + done]).view("<u8")[:, 0]
            x = np.where(left < 8, x & _FIRST_BYTES[np.minimum(left, 8)], x)
            h[own] = mix(h[own] * _ODD + (x ^ _KEYS[2 + lane]))
            done += 8
            own = own[left > 8]
        for i in np.flatnonzero(size > LONG):
            h[i] = xxhash.xxh3_64_intdigest(buf[w.start[i] : w.end[i]].tobytes(), 1 + lane)
    return h


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` consecutive words; shorter by width - 1 than h."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out * _ODD + h[k : k + n] + np.uint64(k + 1))
    return out
