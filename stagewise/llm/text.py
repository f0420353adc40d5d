"""Vectorised words and rolling hashes over Arrow text columns.

A slice of documents is one flat byte array. Words are runs of bytes outside a
separator class, hashed with a polynomial over a table of random byte codes;
prefix sums give the hash of every word, and again of every word window, in a
few passes of numpy without a loop over documents.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; the arrays of a slice take many times as much for a moment.
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of ``[^\x20\x09-\x0D]+`` words.
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[9, 10, 11, 12, 13, 32]] = False
CODES_LOWER = _CODES[_LOWER]
CODES_EXACT = _CODES

_powers: dict[int, np.ndarray] = {}


def _power_table(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    table = _powers.get(key)
    if table is None or len(table) < n:
        size = max(n, SLICE_BYTES + 1)
        table = np.empty(size, dtype=np.uint64)
        table[0] = 1
        done = 1
        with np.errstate(over="ignore"):
            step = np.uint64(base)
            while done < size:
                take = min(done, size - done)
                table[done : done + take] = table[:take] * step
                step = step * step if take == done else step
                done += take
        _powers[key] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string column; null reads as empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which a Python worker, which Spark keeps for later tasks, gives freed memory back."""

    def then_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return then_release


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``limit`` bytes of text, or one longer document."""
    data, off = text_buffer(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        end = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), n)
        yield batch.slice(start, end - start), data[off[start] : off[end]], off[start : end + 1] - off[start]
        start = end


class Words:
    """Words of a slice: byte bounds, hashes and the word range of each document."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool, word_bytes: np.ndarray = WORD_BYTES):
        n = len(data)
        inside = word_bytes[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[off] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        before &= ~edge[:n]
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        after &= ~edge[1:]
        self.end = np.flatnonzero(inside & ~after) + 1
        #: Word i of document d has bounds[d] <= i < bounds[d + 1].
        self.bounds = np.searchsorted(self.start, off).astype(np.int64)
        codes = CODES_LOWER if lower else CODES_EXACT
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(codes[data] * _power_table(_BASE, n), out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * _power_table(_BASE_INV, n + 1)[self.start])

    def doc_of(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def window_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of word windows [start, start + length), the length included."""
    n = len(h)
    with np.errstate(over="ignore"):
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(h * _power_table(_STEP, n), out=total[1:])
        value = (total[start + length] - total[start]) * _power_table(_STEP_INV, n + 1)[start]
        return mix(value + np.uint64(0x632BE59BD9B4E019) * np.asarray(length).astype(np.uint64))


class LocalRepeats:
    """Marks keys that one task has met before, so that a hot key leaves a task once.

    ``mark`` returns, per row, whether it stands for its key in the shuffle, and
    whether the key is known to repeat. Memory is bounded by ``limit`` keys; a
    forgotten key only sends one more row.
    """

    def __init__(self, limit: int = 200_000):
        self.limit = limit
        self.hot = np.empty(0, dtype=np.uint64)

    def mark(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.ones(len(keys), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        runs = np.flatnonzero(new)
        count = np.diff(np.append(runs, len(keys)))
        stands = np.zeros(len(keys), dtype=bool)
        stands[order[runs]] = True
        repeated = np.empty(len(keys), dtype=bool)
        repeated[order] = np.repeat(count > 1, count)
        if len(self.hot) and len(keys):
            at = np.minimum(np.searchsorted(self.hot, keys), len(self.hot) - 1)
            known = self.hot[at] == keys
            stands &= ~known
            repeated |= known
        fresh = ordered[runs[count > 1]]
        if len(fresh):
            self.hot = np.union1d(self.hot, fresh)
            if len(self.hot) > self.limit:
                self.hot = fresh if len(fresh) <= self.limit else fresh[: self.limit]
        return stands, repeated
