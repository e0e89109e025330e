"""Whole-batch text kernels in numpy: words, hashes and slices of Arrow strings.

Texts stay UTF-8 bytes in one flat buffer. A white-space byte never occurs
inside a multi-byte character, so word edges can be found on bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)
BASE2 = U64(0xC2B2AE3D27D4EB4F | 1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = U64(pow(key, -1, 1 << 64))
        out = []
        for b in (U64(key), inverse):
            a = np.full(size, b, U64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers[key] = have = (out[0], out[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def flat(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string array; null counts as empty."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    if strings.null_count:
        strings = strings.fill_null("")
    wide = pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type)
    _, offsets, data = strings.buffers()
    n = len(strings)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[strings.offset : strings.offset + n + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of about `most` text bytes, so that the
    kernels' temporaries stay small; a longer text has a batch of its own."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, off = flat(batch.column(column))
        start = 0
        while start < n:
            end = int(np.searchsorted(off, off[start] + most, "right")) - 1
            end = min(n, max(start + 1, end))
            yield batch.slice(start, end - start)
            start = end


def _spans(inside: np.ndarray, off: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the marked bytes; a text's edge is one of a word as well."""
    first[1:] |= inside[1:] & ~inside[:-1]
    last[:-1] |= inside[:-1] & ~inside[1:]
    first[:1] |= inside[:1]
    last[-1:] |= inside[-1:]
    edge = off[1:-1]
    at = edge[(edge > 0) & (edge < len(inside))]
    first[at] |= inside[at]
    last[at - 1] |= inside[at - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every run of other than white space, and per text the
    range of its words."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SPACE[data]
    return _spans(inside, off, np.zeros(len(data), bool), np.zeros(len(data), bool))


#: Scripts that put no space between words: each of their characters is a word.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_kinds: list[np.ndarray] = []


def letter_kinds() -> np.ndarray:
    """For every code point: 0 between words, 1 inside one, 2 a word of its own."""
    if not _kinds:
        out = np.zeros(0x110000, np.uint8)
        out[[c for c in range(0x110000) if unicodedata.category(chr(c))[0] in "LNM"]] = 1
        for low, high in UNSPACED:
            out[low : high + 1] *= 2
        _kinds.append(out)
    return _kinds[0]


def letter_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, of runs of letters, digits and marks in the sense of Unicode; where a
    script puts no space between words, each character is one."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    kinds = letter_kinds()
    kind = kinds[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if not len(lead):
        kind[data >= 0x80] = 0
        return _spans(kind > 0, off, first, last)
    byte = [data[np.minimum(lead + d, len(data) - 1)].astype(np.int32) & (0xFF if d == 0 else 0x3F) for d in range(4)]
    size = 2 + (byte[0] >= 0xE0) + (byte[0] >= 0xF0)
    two, three = (byte[0] & 0x1F) << 6 | byte[1], (byte[0] & 0x0F) << 12 | byte[1] << 6 | byte[2]
    four = (byte[0] & 0x07) << 18 | byte[1] << 12 | byte[2] << 6 | byte[3]
    class_ = kinds[np.minimum(np.select([size == 2, size == 3], [two, three], four), 0x10FFFF)]
    for d in range(4):
        there = size > d
        kind[lead[there] + d] = class_[there]
    own = class_ == 2
    if own.any():
        at, end = lead[own], lead[own] + size[own]
        first[at] = last[end - 1] = True
        before, after = at[at > 0] - 1, end[end < len(data)]
        last[before] |= kind[before] > 0
        first[after] |= kind[after] > 0
    return _spans(kind > 0, off, first, last)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """A 64-bit polynomial hash of each span of bytes, mixed with its length."""
    if not len(starts):
        return np.empty(0, U64)
    up, down = powers(base, len(data) + 1)
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x165667B19E3779F9))


def row_of(bounds: np.ndarray) -> np.ndarray:
    """For ranges given by their bounds, the row number of each member."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U64(0x9FB21C651E98DF25) + (b ^ U64(0xD6E8FEB86659FD93)) * U64(0xA0761D6478BD642F))
