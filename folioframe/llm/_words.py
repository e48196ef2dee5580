"""Word fingerprints of Arrow text columns, whole columns at a time in numpy.

A word is a maximal run of bytes outside a separator set; all separators used here are
ASCII, so runs of UTF-8 bytes are runs of characters. A word's fingerprint is a 64-bit
polynomial over its bytes, finished by a mixer; two different words share one with a
chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from ._session import forget

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Space and \t to \r.
BLANKS = separators((0x20, 0x20), (0x09, 0x0D))
#: Everything ASCII that is neither a letter nor a digit.
PUNCTUATION = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ U(salt * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


class Words(NamedTuple):
    """The words of rows low to high of a batch: fingerprints row after row, and each row's count."""

    low: int
    high: int
    hashes: np.ndarray
    counts: np.ndarray
    #: Fingerprints of the words' beginnings, one array for each asked length in bytes; of their endings where it is negative.
    beginnings: tuple[np.ndarray, ...] = ()


#: Bytes that are hashed at a time; bounds the arrays, not the text.
PIECE = 1 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a text column; a null row is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)


def word_chunks(column: pa.Array, seps: np.ndarray, max_bytes: int = 2 * PIECE, lower: bool = True, beginnings: tuple[int, ...] = ()) -> Iterator[Words]:
    """Words of all rows, in chunks of whole rows of about max_bytes."""
    forget()
    offsets, data = text_buffers(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1)
        b = data[offsets[low] : offsets[high]]
        cuts = offsets[low : high + 1] - offsets[low]
        starts, ends = spans(b, cuts, seps)
        b = LOWER[b] if lower else b
        short = tuple(span_hashes(b, starts, np.minimum(ends, starts + n)) if n > 0 else span_hashes(b, np.maximum(starts, ends + n), ends) for n in beginnings)
        yield Words(low, high, span_hashes(b, starts, ends), np.diff(np.searchsorted(starts, cuts)), short)
        low = high


def spans(b: np.ndarray, cuts: np.ndarray, seps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in b; cuts are the rows' borders."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~seps[b]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(b))]
    first[inner] = inside[inner]
    last[inner - 1] = inside[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of the byte spans."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        zero, n = starts[i], int(ends[j - 1] - starts[i])
        powers, inverse = _powers(n + 1)
        sums = np.empty(n + 1, U)
        sums[0] = 0
        np.cumsum(_BYTE[b[zero : zero + n]] * powers[:n], out=sums[1:])
        s, e = starts[i:j] - zero, ends[i:j] - zero
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U))
        i = j
    return out


def hash_of(word: str) -> int:
    """The fingerprint of one word."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])
