"""Vectorised scans over Arrow text columns.

A batch's UTF-8 buffer is viewed as bytes without copying. Words are the runs of
bytes other than 0x20 and 0x09-0x0D; since those are ASCII, byte runs and code
point runs agree. Documents are handled in chunks of about ``CHUNK`` bytes, never
cut, so memory follows the chunk (or the longest single text).

A word's 64-bit hash is the polynomial sum((b_i + 1) * BASE**i) mod 2**64 over its
bytes, taken from prefix sums, so a whole chunk costs a few array passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 19
BASE = 0x2545F4914F6CDD1D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        table = np.empty(size, np.uint64)
        table[0] = 1
        filled = 1
        while filled < size:
            step = min(filled, size - filled)
            np.multiply(table[:step], np.uint64(pow(base, filled, 1 << 64)), out=table[filled : filled + step])
            filled += step
        if size <= 4 * CHUNK:
            _powers[base] = table
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of 64-bit values."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(27)
    y *= np.uint64(0x94D049BB133111EB)
    y ^= y >> np.uint64(31)
    return y


class Chunk:
    """Whole documents ``lo:hi`` of a batch as one byte array with offsets."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def __len__(self) -> int:
        return self.hi - self.lo

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` bytes within documents.

        Returns starts, ends and the pointer of each document into them.
        """
        n = len(inside)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        first = np.empty(n, bool)
        first[0] = True
        np.logical_not(inside[:-1], out=first[1:])
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        first[cuts] = True
        first &= inside
        last = np.empty(n, bool)
        last[-1] = True
        np.logical_not(inside[1:], out=last[:-1])
        last[cuts - 1] = True
        last &= inside
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~IS_SPACE[self.data])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial hash of each byte run (uint64, wrapping)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power_table(BASE, n)[:n]
    np.cumsum(terms, out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * _power_table(BASE_INVERSE, n)[starts]


def hash_bytes(word: bytes) -> int:
    """``hash_runs`` for one word, for tests and small tables."""
    h = 0
    for b in reversed(word):
        h = (h * BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Cut a string column into chunks of whole documents; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offset_buffer, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def doc_index(pointer: np.ndarray) -> np.ndarray:
    """The document of every word, from the documents' pointer into words."""
    return np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))
