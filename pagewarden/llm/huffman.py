"""Canonical length-limited Huffman codes of integers, and blocks of them that decode on their own.

Lengths come from package-merge: a level is the symbols' weights merged with the pairs of the level before, and what the
first 2n - 2 items of the last level hold, walked back level by level, gives every symbol its length. A code is known
from its lengths alone (canonical: by length, then by symbol), so a codebook is one byte a symbol.

A block holds n consecutive ids of a part (a run of documents in order), the documents that have ids in it, the bit
offset of every `step`-th id, and the bits. Encoding is a sum of shifted codes into 32-bit words; decoding steps all
checkpoints of a block at once through one table of 2^(longest code) entries.

    block: magic 4s | part u4 | first id in the part u8 | ids u4 | documents u4 | step u4 | payload bytes u4 | CRC-32 of the rest u4
           doc_id i8[d] | has doc_id u1[d] | start in the part u8[d] | ids of the document u8[d] | bit offsets u4[ceil(n / step)] | payload
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC = b"PWT1"
HEAD = struct.Struct("<4sIQIIIII")


def code_lengths(counts: np.ndarray, limit: int = 18) -> np.ndarray:
    """Code length of each symbol (0 where its count is 0), none above limit, of least total size under that limit.

    The limit gives way where the symbols are too many for it.
    """
    symbols = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(symbols) < 2:
        out[symbols] = 1
        return out
    limit = max(limit, int(len(symbols) - 1).bit_length())
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    leaf = counts[symbols].astype(np.int64)
    flags, level = [], leaf
    for i in range(limit):
        if i:
            pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
            both = np.concatenate([leaf, pairs])
            order = np.argsort(both, kind="stable")
            level = both[order]
        else:
            order = np.arange(len(leaf))
        flags.append(order < len(leaf))
    lengths, take = np.zeros(len(leaf), np.uint8), 2 * len(leaf) - 2
    for is_leaf in reversed(flags):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[symbols] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol as a number of `lengths` bits."""
    codes, code, was = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    for n in np.unique(lengths[order]).tolist():
        same = order[lengths[order] == n]
        code <<= n - was
        codes[same] = code + np.arange(len(same))
        code, was = code + len(same), n
    return codes


def table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits of the longest code, symbol, length) for every number of that many bits."""
    longest = max(1, int(lengths.max(initial=0)))
    order = np.flatnonzero(lengths)
    order = order[np.argsort(lengths[order], kind="stable")]
    spans = np.left_shift(1, longest - lengths[order].astype(np.int64))
    symbol, length = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    n = int(spans.sum())
    symbol[:n], length[:n] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return longest, symbol, length


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int) -> tuple[bytes, np.ndarray]:
    """The bits of ids, and the bit offset of every step-th id. Codes have at most 32 bits."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    if not len(ids):
        return b"", at[::step].astype("<u4")
    shifted = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word, n = at >> 5, int(end[-1] + 31 >> 5) + 1
    # No two codes share a bit, so sums are unions; a double holds a sum below 2^32.
    sums = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n + 1)[:n]
    return sums.astype(np.uint64).astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], at[::step].astype("<u4")


def unpack(payload: bytes, offsets: np.ndarray, n: int, step: int, decoder: tuple[int, np.ndarray, np.ndarray], begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids begin to end of a block of n ids: all checkpoints between them advance together, one id in a step."""
    longest, symbol, length = decoder
    end = n if end is None else min(end, n)
    first, last = begin // step, -(-end // step)
    b = np.frombuffer(payload + b"\0" * 8, np.uint8).astype(np.uint32)
    windows = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    at = offsets[first:last].astype(np.int64)
    out = np.zeros((len(at), step), np.uint32)
    stop = 8 * len(payload)
    for k in range(step):
        here = np.minimum(at, stop)  # the last checkpoint may have fewer ids
        value = windows[here >> 3] << (here & 7).astype(np.uint32) >> np.uint32(32 - longest)
        out[:, k] = symbol[value]
        at += length[value]
    return out.reshape(-1)[begin - first * step : end - first * step]


def block(part: int, first: int, ids: np.ndarray, docs: list[tuple[int | None, int, int]], codes: np.ndarray, lengths: np.ndarray, step: int) -> bytes:
    """docs: (doc_id, start in the part, ids of the whole document) of the documents that have ids here, in order."""
    payload, offsets = pack(ids, codes, lengths, step)
    rest = b"".join(
        (
            np.array([d or 0 for d, _, _ in docs], "<i8").tobytes(), np.array([d is not None for d, _, _ in docs], np.uint8).tobytes(),
            np.array([s for _, s, _ in docs], "<u8").tobytes(), np.array([n for _, _, n in docs], "<u8").tobytes(), offsets.tobytes(), payload,
        )
    )
    return HEAD.pack(MAGIC, part, first, len(ids), len(docs), step, len(payload), zlib.crc32(rest)) + rest


def blocks(data: memoryview) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]]:
    """(part, first, n, step, doc_ids, has_id, starts, sizes, offsets, payload) of every block of a file; a line break ends each."""
    at = 0
    while at < len(data):
        magic, part, first, n, docs, step, size, crc = HEAD.unpack_from(data, at)
        at += HEAD.size
        marks = -(-n // step)
        end = at + 25 * docs + 4 * marks + size
        if magic != MAGIC or len(data) <= end or zlib.crc32(data[at:end]) != crc or data[end] != 10:
            raise ValueError(f"a damaged block before byte {end}")
        ids = np.frombuffer(data, "<i8", docs, at)
        has = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        starts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        sizes = np.frombuffer(data, "<u8", docs, at + 17 * docs).astype(np.int64)
        offsets = np.frombuffer(data, "<u4", marks, at + 25 * docs)
        yield part, first, n, step, ids, has, starts, sizes, offsets, bytes(data[end - size : end])
        at = end + 1


def crc_shift(crc: int, after: int) -> int:
    """The part that a CRC-32 of some bytes has in that of a longer string in which `after` bytes follow them.

    The CRC of a string is the exclusive or of its pieces' parts. Multiplies by x^(8 * after) modulo the polynomial.
    """

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 0x80000000:
                out ^= a
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
            b = b << 1 & 0xFFFFFFFF
        return out

    power = 0x00800000  # x^8, bits reversed
    while after:
        if after & 1:
            crc = times(crc, power)
        power, after = times(power, power), after >> 1
    return crc
