"""Vectorised word scanning of Arrow text columns.

A block of texts is one byte array with offsets. Words are runs of bytes that
are no separators; their 64-bit fingerprints come from prefix sums of a
polynomial modulo 2**64, so no Python object is made for a word. Separators are
ASCII, so byte runs are the words of the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once; a longer text is scanned alone.
BLOCK_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)

SPACE, ALNUM = "space", "alnum"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE_WORD = np.ones(256, bool)
IS_SPACE_WORD[[9, 10, 11, 12, 13, 32]] = False
IS_ALNUM_WORD = np.zeros(256, bool)
IS_ALNUM_WORD[48:58] = IS_ALNUM_WORD[65:91] = IS_ALNUM_WORD[97:123] = IS_ALNUM_WORD[128:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, BLOCK_BYTES + 1)
        pow_, inv = np.full(size, _BASE), np.full(size, _BASE_INV)
        pow_[0] = inv[0] = 1
        tables = np.cumprod(pow_, dtype=np.uint64), np.cumprod(inv, dtype=np.uint64)
        if n > BLOCK_BYTES + 1:  # one long text: not kept
            return tables
        _POW, _INV = tables
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, block_bytes: int = BLOCK_BYTES, block_rows: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of blocks of whole texts, bounded in bytes and rows."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + block_bytes, "right")) - 1
        j = min(max(j, i + 1), i + block_rows, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


@dataclass
class Scan:
    """Words of a block: byte bounds, document index, fingerprint."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # n+1 bounds of each document's words
    prefix: np.ndarray | None = None

    @property
    def n_docs(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    pow_, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= pow_[: len(data)]
    np.cumsum(values, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of byte ranges."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start])


def scan(data: np.ndarray, offsets: np.ndarray, kind: str = SPACE, lower: bool = True) -> Scan:
    is_word = (IS_SPACE_WORD if kind == SPACE else IS_ALNUM_WORD)[data]
    if lower:
        data = LOWER[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    prefix = prefix_sums(data)
    hashes = range_hash(prefix, start, end)
    first = np.searchsorted(start, offsets, "left")
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Scan(data, offsets, start, end, doc, hashes, first, prefix)


_COEF = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n neighbouring words, across documents too."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, np.uint64(n))
    for j in range(n):
        out += hashes[j : j + m] * _COEF[j % 64] * np.uint64(1 + 2 * (j // 64))
    return mix(out)


def inside(scan_: Scan, n: int) -> np.ndarray:
    """Which windows of n words lie in one document."""
    m = len(scan_.hash) - n + 1
    return scan_.doc[:m] == scan_.doc[n - 1 :] if m > 0 else np.zeros(0, bool)


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between neighbouring bounds."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[bounds])


def hash_words(words: list[str], lower: bool = True) -> np.ndarray:
    """Fingerprints of given words, equal to those that `scan` finds."""
    raw = [w.encode() for w in words]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=offsets[1:])
    data = np.frombuffer(b"".join(raw), np.uint8)
    if lower:
        data = LOWER[data]
    return range_hash(prefix_sums(data), offsets[:-1], offsets[1:])
