"""Word and byte kernels over Arrow string buffers.

A batch of texts is one run of UTF-8 bytes with offsets; words, their hashes
and their n-grams are found for all texts of the batch at once with numpy, so
no Python string is made per word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xC2B2AE3D27D4EB4F | 1
#: Bytes worked on at a time; bounds the working memory.
BLOCK = 1 << 20
#: Ranges of more bytes are hashed one by one.
LONG = 64
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _table(inside) -> np.ndarray:
    out = np.zeros(256, bool)
    for b in range(256):
        out[b] = inside(b)
    return out


#: Bytes of words that white space (space, \t to \r) separates.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Bytes of words of digits, letters and all that is not ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


#: Stretches of any length are hashed by polynomials modulo this prime at two points.
PRIME = (1 << 31) - 1
_POINTS = (0x4F1BBCDC, 0x2545F491)
_tables: dict[tuple[int, int], np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """Values below 2 ** 62 modulo PRIME."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo PRIME."""
    size = 1 << max(12, int(n - 1).bit_length())
    if (base, size) not in _tables:
        out = np.ones(1, np.int64)
        while len(out) < size:
            out = np.concatenate([out, _fold(out * pow(base, len(out), PRIME))])
        if size > 4 * BLOCK:
            return out[:n]
        _tables[base, size] = out
    return _tables[base, size][:n]


class Stretches:
    """Hashes of any byte ranges of ``data``, from running sums at two points."""

    def __init__(self, data: np.ndarray):
        self.n, self.sums = len(data), []
        value = data.astype(np.int64) + 1
        for x in _POINTS:
            run = np.zeros(len(data) + 1, np.int64)
            np.cumsum(_fold(value * _powers(x, len(data))), out=run[1:])
            self.sums.append((run, _powers(pow(x, -1, PRIME), len(data) + 1)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        high, low = (_fold(_fold(run[end] - run[start]) * back[start]) for run, back in self.sums)
        return mix((high.view(np.uint64) << U(31) | low.view(np.uint64)) + (end - start).astype(np.uint64) * U(_BASE))

    def every(self, length: int) -> np.ndarray:
        """The hash of each stretch of ``length`` bytes."""
        m = self.n - length + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        high, low = (_fold(_fold(run[length:] - run[:m]) * back[:m]) for run, back in self.sums)
        return mix((high.view(np.uint64) << U(31) | low.view(np.uint64)) + U(length * _BASE & (1 << 64) - 1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if n == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK // 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``limit`` bytes: first and last text, their bytes and offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class Words:
    """The words of a run of texts: byte ranges, and ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        inside = table[data]
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = inside
        edges = offsets[(offsets < len(data)) & (offsets >= 0)]
        start = inside & ~before[:-1]
        start[edges] = inside[edges]
        after = np.empty(len(data) + 1, bool)
        after[:-1] = inside
        after[-1] = False
        end = inside & ~after[1:]
        last = offsets[offsets > 0] - 1
        end[last] = inside[last]
        self.data, self.offsets = data, offsets
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, of A-Z as a-z if ``lower``."""
        return range_hashes(LOWER[self.data] if lower else self.data, self.start, self.end)

    def span(self, i: int, j: int, lower: bool = False) -> list[bytes]:
        """Words i to j - 1 as bytes."""
        data = self.data
        out = [data[self.start[k] : self.end[k]].tobytes() for k in range(i, j)]
        return [w.lower() for w in out] if lower else out


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: eight bytes at a time are mixed in, ranges over LONG bytes take BLAKE2b.

    Each step mixes all bits of the state, so no family of texts (such as
    Thue-Morse words, which any polynomial modulo 2 ** 64 confuses) collides
    more often than chance.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * U(0xA24BAED4963EE407) + U(_BASE))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    left = np.flatnonzero(size <= LONG)
    at = 0
    while len(left):
        left = left[size[left] > at]
        word = eights[start[left] + at] & _FIRST[np.minimum(size[left] - at, 8)]
        out[left] = mix((out[left] ^ word) * U(_GRAM) + U(at + 1))
        at += 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return out


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of words[i : i + n] for each i; the caller drops those that cross texts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= U(_GRAM)
        out += words[k : k + m]
    return mix(out + U(n))


def gram_texts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which grams lie inside one text: their start words and how many each text has."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    total = int(count.sum())
    base = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(total) + base, count


def covered(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in any range [start, start + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(start + length, n), -1)
    return np.cumsum(step[:-1]) > 0
