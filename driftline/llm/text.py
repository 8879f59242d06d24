"""Byte-level helpers for Arrow batches: words, word hashes and shingle sets of whole texts.

Words are maximal runs of bytes other than space and 0x09-0x0D. UTF-8 never uses those bytes inside a longer
character, so working on bytes gives the same words as working on characters. Hashes have 64 bits; two different
words or shingles meet with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
IS_WORD = (~IS_SPACE).view(np.int8)
#: Letters and digits of ASCII and every byte of longer characters.
IS_ALNUM = np.zeros(256, np.int8)
IS_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64((salt * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & 0xFFFFFFFFFFFFFFFF))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(1 << 12, 1 << (n - 1).bit_length())
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
        _inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE_INVERSE)], dtype=np.uint64)
    return _powers, _inverses


def texts(column: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of each text of a string column, without copies; null is empty."""
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else ()
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if len(column) else ()
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(len(column)):
        yield data[:0] if nulls is not None and nulls[i] else data[offsets[i] : offsets[i + 1]]


def spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ones in ``flags`` (int8)."""
    edges = np.flatnonzero(np.diff(flags, prepend=np.int8(0), append=np.int8(0)))
    return edges[::2], edges[1::2]


def span_hasher(data: np.ndarray):
    """A function of (starts, ends) that hashes data[start:end] for each pair, from one pass of prefix sums."""
    n = len(data)
    powers, inverses = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hasher(data)(starts, ends)


def word_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash of every word, in order; with ``lower``, A-Z count as a-z."""
    starts, ends = spans(IS_WORD[data])
    return span_hashes(LOWER[data] if lower else data, starts, ends)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive words."""
    count = len(hashes) - n + 1
    out = np.zeros(max(count, 0), np.uint64)
    for k in range(n):
        if count > 0:
            out = mix(out + hashes[k : k + count])
    return out


def shingle_set(data: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles of ``n`` words, sorted; fewer words make one shingle, no word none."""
    hashes = word_hashes(data)
    if not len(hashes):
        return hashes
    if len(hashes) < n:
        return salted(windows(hashes, len(hashes)), len(hashes))
    return np.unique(windows(hashes, n))


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)
