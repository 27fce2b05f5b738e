"""Words and polynomial hashes of many texts at once, as numpy arrays over an Arrow buffer.

A text column's bytes lie in one buffer, so word bounds, word hashes and hashes of windows are a few array operations
for a whole slice of documents, with no Python object for a word.

A hash of symbols s[i..j) is sum(s[t] * B**t) * B**-i modulo 2**64 with an odd B: any window's hash comes from two
prefix sums. Symbols are random 64-bit values of a table (bytes) or word hashes.

Such hashes find candidates. Where equal strings are told by a hash alone, it is one of `digests`, which are cryptographic.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SLICE = 1 << 18

_is_word = np.ones(256, np.uint8)
_is_word[[32, 9, 10, 11, 12, 13]] = 0
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def digests(parts: Iterable[bytes]) -> np.ndarray:
    """128-bit BLAKE2 digests as rows of two longs: strings of equal digests are taken as equal."""
    return np.frombuffer(b"".join([blake2b(x, digest_size=16).digest() for x in parts]), np.int64).reshape(-1, 2)


@cache
def byte_table(which: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[which]))


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(n: int, which: int, inverse: bool = False) -> np.ndarray:
    """B**0 .. B**(n-1), or of its inverse."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        b = BASES[which] if not inverse else pow(BASES[which], -1, 1 << 64)
        have = np.full(max(n, SLICE + 2), b, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if len(have) <= 4 * SLICE:
            _powers[which, inverse] = have
    return have[:n]


def prefix(symbols: np.ndarray, which: int) -> np.ndarray:
    p = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * powers(len(symbols), which), out=p[1:])
    return p


def window_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    return (p[end] - p[start]) * powers(len(p), which, True)[start]


def slices(texts: pa.Array, most: int = SLICE, rows: int = 1 << 30) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of at most `rows` rows that hold about `most` bytes; a longer text is a run of its own."""
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    off = np.frombuffer(at, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        end = min(end, row + rows, len(texts))
        yield row, raw[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def words(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the ASCII-white-space separated words, and word offsets of each document."""
    if lower:
        raw = _lower[raw]
    n = len(raw)
    inside = _is_word[raw]
    edge = np.zeros(n + 1, np.uint8)
    edge[off] = 1  # a word ends at the end of its document
    before = np.zeros(n, np.uint8)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (edge[:n] | (1 - before)))
    after = np.zeros(n, np.uint8)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (edge[1:] | (1 - after))) + 1
    h = mix(window_hash(prefix(byte_table(0)[raw], 0), starts, ends, 0) + (ends - starts).astype(np.uint64))
    return h, starts, ends, np.searchsorted(starts, off)


def spaced(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words alone, each followed by one space, as bytes; starts and ends of the words in them."""
    size = ends - starts
    to = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + step] = raw[np.repeat(starts, size) + step]
    return out.tobytes(), to, to + size


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of every m neighbours."""
    n = len(x) - m + 1
    if m == 1:
        return x
    rows = -(-len(x) // m) + 1
    y = np.full(rows * m, np.iinfo(x.dtype).max, x.dtype)
    y[: len(x)] = x
    y = y.reshape(rows, m)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[m - 1 : m - 1 + n])
