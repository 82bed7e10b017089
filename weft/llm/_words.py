"""Words of many texts at once, over the UTF-8 bytes of an Arrow batch.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. Words are hashed to
64 bits by a polynomial over the bytes whose prefix sums make every word one subtraction, so no
Python object is made for a word. Texts are taken in slabs of about a quarter of a megabyte, which bounds the
memory whatever the batch holds; one longer text is a slab of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLAB = 1 << 18
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: White space and ASCII punctuation.
PUNCTUATION = _SPACE | np.isin(np.arange(256), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLAB + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * SLAB:
            _powers[base] = have
    return have[:n]


def slabs(column: pa.Array | pa.ChunkedArray, size: int = SLAB) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (exclusive) and hash of every word; words also end where a text does.

    between: which bytes stand between words. lower: whether A-Z count as a-z.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    inside = ~between[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * _power(_BASE, len(data)), out=total[1:])
    hashed = (total[end] - total[start]) * _power(_INVERSE, len(data))[start]
    return start, end, mix(hashed + (end - start).astype(np.uint64))


def shingles(hashed: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of k words of each text, and how many each text has.

    counts: words of each text. A text with fewer than k words, but some, has one: all its words.
    """
    n = len(hashed)
    owner = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(np.cumsum(counts), counts)
    value = np.zeros(n, np.uint64)
    padded = np.concatenate([hashed, np.zeros(k, np.uint64)])
    left = stop - np.arange(n)  # words from here to the end of the text
    for j in range(k):
        value = value * np.uint64(0xD6E8FEB86659FD93) + np.where(left > j, padded[j : j + n], np.uint64(0))
    first = np.zeros(n, bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    keep = (left >= k) | (first & (left < k))
    value = mix(value + np.minimum(left, k).astype(np.uint64))[keep]
    return value, np.bincount(owner[keep], minlength=len(counts))
