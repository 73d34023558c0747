"""Vectorised view of a batch of texts: words, lines and their hashes.

Texts stay in their Arrow buffer (one byte array and offsets), so a task never
makes a Python string per word.  Word separators are the six ASCII white-space
bytes 0x20 and 0x09-0x0D, the same set as the contract pattern
``[^\\x20\\x09-\\x0D]+``; UTF-8 multi-byte characters never hold such bytes.

Hashes are 64-bit: a polynomial over random byte values modulo 2**64 with an
odd base, read off prefix sums, followed by a mixing step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept and grown on demand."""
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, CHUNK_BYTES + 1)
        a, b = np.full(m, _BASE), np.full(m, _INV)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


class Chunk:
    """Some whole texts, rows ``lo`` to ``hi`` of a batch: ``data`` and ``off``."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.lo, self.hi, self.off = lo, hi, off
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        self.space = IS_SPACE[data]

    def __len__(self) -> int:
        return self.hi - self.lo

    def prefix(self) -> np.ndarray:
        """Prefix sums of the weighted byte values, one longer than ``data``."""
        n = len(self.data)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * _powers(n + 1)[0][:n], out=out[1:])
        return out

    def span_hash(self, start: np.ndarray, end: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hash of each byte span."""
        p = self.prefix() if prefix is None else prefix
        return mix((p[end] - p[start]) * _powers(len(self.data) + 1)[1][start])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and the first word of each text (one longer)."""
        n = len(self.data)
        word = ~self.space
        first, last = word.copy(), word.copy()
        if n:
            first[1:] &= self.space[:-1]
            last[:-1] &= self.space[1:]
            cut = self.off[1:-1]
            cut = cut[(cut > 0) & (cut < n)]
            first[cut] = word[cut]
            last[cut - 1] = word[cut - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(start, self.off)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Starts and ends of the ``\n``-separated lines (every text has at least one), first line of each text."""
        nl = np.flatnonzero(self.data == 10)
        begin = np.concatenate([self.off[:-1], nl + 1])
        row = np.concatenate([np.arange(len(self)), np.searchsorted(self.off, nl, "right") - 1])
        order = np.lexsort((begin, row))
        begin, row = begin[order], row[order]
        first = np.searchsorted(row, np.arange(len(self) + 1))
        end = np.empty_like(begin)
        if len(begin):
            end[:-1] = begin[1:] - 1
            end[first[1:] - 1] = self.off[1:]
        return begin, end, first


def chunks(column: pa.Array, lower: bool = False, size: int = CHUNK_BYTES):
    """Whole texts in chunks of about ``size`` bytes (a longer text alone)."""
    data, off = text_buffer(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield Chunk(lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], lower)
        lo = hi


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words inside one text: (position of its first word, hash)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    total = np.zeros(n - k + 1, np.uint64)
    c = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += hashes[j:n - k + 1 + j] * c
            c = c * np.uint64(0xA24BAED4963EE407)
    ok = np.ones(n - k + 1, bool)
    for b in range(1, k):  # a window may not reach over the first word of a later text
        at = first[1:-1] - b
        ok[at[(at >= 0) & (at < len(ok))]] = False
    # texts shorter than k words leave overlapping cuts, all covered by the marks above
    pos = np.flatnonzero(ok)
    return pos, mix(total[pos])
