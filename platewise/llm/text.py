"""Words, hashes and bounded slices of Arrow text columns, computed on whole buffers.

A word is a run of bytes other than space and 0x09-0x0D. Nothing here splits a word at another
kind of white space, and a NULL text counts as an empty one.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RANDOM = np.random.default_rng(20240607)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_ODD = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tidy(work):
    """``work`` on the batches of a task, after which the memory it used goes back to the machine.

    Python workers outlive their tasks: what the allocators keep for later would stay with a worker through all later
    stages, in which other workers of the same executor need it.
    """
    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    global _powers
    _powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def free_name(names: list[str], base: str) -> str:
    """``base``, lengthened until no column has that name, whatever its case."""
    taken = {name.lower() for name in names}
    while base in taken:
        base += "_"
    return base


def slices(batch: pa.RecordBatch, text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``limit`` bytes of text each; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    _, offsets = buffer_of(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the int64 offset of each row, starting at 0."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32) if where is not None and where.size else np.zeros(1, np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    last = np.empty(len(data), bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    ends = offsets[1:]
    last[ends[ends > 0] - 1] = True
    starts = np.flatnonzero(first & inside)
    return starts, np.flatnonzero(last & inside) + 1, np.searchsorted(offsets, starts, side="right") - 1


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) <= size:
        inverse = np.uint64(pow(_BASE, -1, 2**64))
        tables = []
        for base in (np.uint64(_BASE), inverse):
            table = np.full(size + 1, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        if size > 2 * SLICE_BYTES:  # one huge text: not worth keeping
            return tables[0], tables[1]
        _powers = tables[0], tables[1]
    return _powers


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of every word; A-Z count as a-z when ``lower``."""
    power, inverse = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * power[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD[63])


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words within a row, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:n] == rows[size - 1:])
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += hashes[i:i + n] * _ODD[i]
    return mix(total[at]), at


def per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of a per-byte array within each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the ``size``-word windows of each row.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    starts, ends, rows = words_of(data, offsets)
    hashes = word_hashes(data, starts, ends)
    found, at = windows(hashes, rows, size)
    n_rows = len(offsets) - 1
    cuts = np.searchsorted(rows[at], np.arange(n_rows + 1)) if len(at) else np.zeros(n_rows + 1, np.int64)
    words = np.searchsorted(rows, np.arange(n_rows + 1))
    out = []
    for i in range(n_rows):
        if cuts[i] < cuts[i + 1]:
            part = np.sort(found[cuts[i]:cuts[i + 1]])
            out.append(part[np.concatenate(([True], part[1:] != part[:-1]))])
        elif words[i] < words[i + 1]:
            own = hashes[words[i]:words[i + 1]]
            out.append(mix(np.array([int((own * _ODD[8:8 + len(own)]).sum(dtype=np.uint64))], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
