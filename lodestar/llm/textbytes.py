"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow string column.

A word's identity is a 64-bit hash of its lower-cased bytes: a polynomial of up to LONG bytes, a BLAKE2 digest of more, since long strings
of a certain pattern, such as that of Thue and Morse, collide under any polynomial modulo a power of two. Operators that need
certainty compare the bytes themselves afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled at once; a longer text is handled alone.
CHUNK = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _class(spaces: list[range]) -> np.ndarray:
    table = np.ones(256, bool)
    for r in spaces:
        table[list(r)] = False
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = _class([range(9, 14), range(32, 33)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
ALNUM = _class([range(0x30), range(0x3A, 0x61), range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """_BASE ** i and its inverse for i below n, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 2 * CHUNK), base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h so that (h[j] - h[i]) * _BASE ** -i identifies data[i:j]."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((h[end] - h[start]) * powers(len(h))[1][start])


#: Bytes of a word that a polynomial tells apart well.
LONG = 48


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The identity of each word data[start:end]."""
    out = span_hash(prefix_hash(data), starts, ends)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about size bytes."""
    data, offsets = column_bytes(column)
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each text's first word (one more entry than texts)."""
    inside = kind[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every lower-cased word, and the index of each text's first word."""
    starts, ends, first = words(data, offsets, kind)
    return hashes_of(LOWER[data], starts, ends), first


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct hashes of size consecutive words, sorted; of fewer words, but not none, one hash of all."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        out = out * _BASE + words[k : k + n]
    return np.unique(mix(out + np.uint64(min(size, len(words)))))
