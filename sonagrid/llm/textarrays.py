"""Whole texts as flat numpy arrays: words, their hashes and their documents.

Every function works on one *block*: the UTF-8 bytes of several texts laid end to end.
Blocks hold whole texts of about ``BLOCK_BYTES`` in all, so memory does not depend on the
size of an Arrow batch; a single longer text makes a longer block.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = {_BASE: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(outside: str) -> np.ndarray:
    """Which bytes a class ``[^...]`` of ASCII characters holds; bytes of longer characters are in it."""
    held = np.ones(256, bool)
    held[list(outside.encode("ascii"))] = False
    return held


#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z (A-Z once lower-cased) and whatever is not ASCII.
ALNUM = byte_class("".join(chr(c) for c in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
#: [^\x20\x09-\x0D]
NOT_BLANK = byte_class(" \t\n\x0b\x0c\r")


class Block(NamedTuple):
    first: int  # row of the first text in the batch
    bounds: np.ndarray  # int64, one more than there are texts
    data: np.ndarray  # uint8


class Words(NamedTuple):
    start: np.ndarray  # in the block's bytes
    end: np.ndarray
    text: np.ndarray  # which text of the block
    bounds: np.ndarray  # per text: its words are bounds[i]:bounds[i + 1]


def blocks(column: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of a column, in order; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "")
    if not len(column):
        return
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + block_bytes, "right")) - 1)
        yield Block(i, bounds[i : j + 1] - bounds[i], data[bounds[i] : bounds[j]])
        i = j


def parts(column: pa.Array, rows: int = 512) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a column, for what copies texts before it cuts them into blocks."""
    for first in range(0, len(column), rows):
        yield first, column.slice(first, rows)


def words(block: Block, held: np.ndarray) -> Words:
    """Runs of bytes in the class ``held``; no run crosses from one text into the next."""
    inside = held[block.data]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = block.bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    at = np.searchsorted(start, block.bounds)
    return Words(start, end, np.repeat(np.arange(len(at) - 1), np.diff(at)), at)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** (0 .. n - 1), modulo 2 ** 64."""
    have = _powers[base]
    while len(have) < n:
        with np.errstate(over="ignore"):
            have = np.concatenate([have, have * have[-1] * base])
    _powers[base] = have if len(have) <= 8 * BLOCK_BYTES else _powers[base]
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no visible order (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class SpanHasher:
    """64-bit hashes of byte spans of one array, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = (self.total[end] - self.total[start]) * powers(_INVERSE, int(start.max()) + 1)[start]
        return mix(h ^ (end - start).astype(np.uint64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of some spans of ``data``; see :class:`SpanHasher`."""
    return SpanHasher(data)(start, end) if len(start) else np.zeros(0, np.uint64)


def gram_hashes(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n consecutive words; entry i is the run that starts at word i."""
    count = len(word_hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = h * _BASE + word_hashes[k : k + count]
    return mix(h)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted value in the sorted ``keys``, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def give_back() -> None:
    """Hand freed memory back to the system, as far as the allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def released(task: Callable) -> Callable:
    """A task over batches that gives its memory back at its end: Spark uses the same worker for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def strings(block: Block, start: np.ndarray, end: np.ndarray) -> list[str]:
    """The texts of byte spans."""
    raw = block.data.tobytes()
    return [raw[s:e].decode("utf-8", "replace") for s, e in zip(start.tolist(), end.tolist(), strict=True)]
