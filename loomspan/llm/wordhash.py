"""Words of UTF-8 text as 64-bit hashes, with numpy over whole Arrow buffers.

A word class is a table of 256 flags on bytes: both classes here count every byte of a non-ASCII character as part of a word, so
bytes decide exactly as code points would. Memory is bounded by blocks of about one MB, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
BLOCK = 1 << 20
_R, _M = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * _R)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def _block(low: np.ndarray, own: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(low)
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = own[:-1], own[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    before[inner] = False
    after[inner - 1] = False
    starts, ends = np.flatnonzero(own & ~before), np.flatnonzero(own & ~after) + 1
    if not len(starts):
        return starts, ends, np.zeros(0, U)
    place = np.zeros(n, np.int64)
    place[starts] = starts
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(n), place, out=place)
    longest = int((ends - starts).max())
    np.minimum(place, longest - 1, out=place)
    power = np.full(longest, _R, U)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    value = _BYTES[low]
    value *= power[place]
    value[~own] = 0
    return starts, ends, mix(np.add.reduceat(value, starts) + (ends - starts).astype(U) * _M)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word of the rows that offsets delimit, in order."""
    lo, hi, found, rows = int(offsets[0]), int(offsets[-1]), [], []
    while lo < hi:
        cut = min(hi, lo + BLOCK)
        while cut < hi and table[LOWER[data[cut]]]:  # to the end of the word
            step = table[LOWER[data[cut : cut + 4096]]]
            cut = min(hi, cut + (int(np.argmin(step)) if not step.all() else len(step)))
        low = LOWER[data[lo:cut]]
        own = table[low]
        a, b = np.searchsorted(offsets, lo, "left"), np.searchsorted(offsets, cut, "right")
        starts, _, h = _block(low, own, offsets[a:b] - lo)
        found.append(h)
        rows.append(np.searchsorted(offsets, starts + lo, "right") - 1)
        lo = cut
    return (np.concatenate(found), np.concatenate(rows)) if found else (np.zeros(0, U), np.zeros(0, np.int64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(k), U)
    for i in range(k):
        out *= _M
        out += h[i : i + n]
    return mix(out)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the words of row i begin, for i up to n."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each row; with fewer words the whole sequence as one; without words empty."""
    all_of = grams(h, k)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(all_of[a : b - k + 1]) if b - a >= k else grams(h[a:b], b - a) if b > a else all_of[:0]
