"""Vectorised byte-level text kernels shared by the operators.

A column of texts is handled as one byte buffer with offsets, a bounded number
of bytes at a time.  A word is a maximal run of bytes outside
``0x20, 0x09-0x0D``; a word's 64-bit value is a polynomial over random byte
weights, taken from prefix sums, so no Python object is made for a word.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # bytes of text handled at once (a longer text is handled alone)

WS = np.zeros(256, dtype=bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_weights = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
BYTE_WEIGHT = _weights * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15  # odd, 5 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection with good avalanche)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def released(run: Callable) -> Callable:
    """A task's function that gives its freed memory back to the system when it ends; Python workers outlive tasks."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return task


class Words:
    """Words of a run of texts: byte buffer, text offsets, word bounds and first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, gaps: np.ndarray = WS):
        self.raw, self.offsets = data, offsets
        self.data = LOWER[data] if lower else data
        n = len(data)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.first = np.zeros(len(offsets), np.int64)
            return
        space = gaps[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0], before[1:] = True, space[:-1]
        after[-1], after[:-1] = True, space[1:]
        inner = offsets[(offsets > 0) & (offsets < n)]
        before[inner] = True
        after[inner - 1] = True
        word = ~space
        self.starts = np.flatnonzero(word & before)
        self.ends = np.flatnonzero(word & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.raw[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def hashes(self) -> np.ndarray:
        """A mixed 64-bit value of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        power, inverse = powers(len(self.data))
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_WEIGHT[self.data] * power, dtype=np.uint64, out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Values of all runs of n words; position i is the run that starts at word i."""
    size = max(0, len(hashes) - n + 1)
    out = mix(hashes[:size] + np.uint64(n))
    for k in range(1, n):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + size])
    return out


def sequence_value(hashes: np.ndarray) -> np.uint64:
    """The value of one whole (short) sequence; sequences of other lengths get other values."""
    return grams(hashes, len(hashes))[0]


def column_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batch in slices of about ``limit`` bytes of text, each with its words."""
    if not batch.num_rows:
        return
    data, offsets = column_buffer(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        own = offsets[at : to + 1]
        yield batch.slice(at, to - at), Words(data[own[0] : own[-1]], own - own[0], lower)
        at = to


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of ``width`` values, by doubling."""
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        x = pick(x[: len(x) - step], x[step:])
        reach += step
    return x


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, from batches of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        rows = list(zip(*columns, strict=True))
        at = 0
        for i, key in enumerate(rows):
            if key != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, at = [], key, i
        held.append(batch.slice(at, batch.num_rows - at))
    if held:
        yield pa.Table.from_batches(held)
