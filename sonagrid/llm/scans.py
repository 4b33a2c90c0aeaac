"""Scans along sorted runs that may be longer than a task's share.

Rows are range-partitioned and sorted by a key and an order, so one run (the rows of a key) may
be dealt over many tasks. Each task scans what it has and writes it; what the run brought along
from earlier tasks is one value a task, which the driver chains and the second pass adds to the
rows of each task's first run. The written table cuts the lineage, so both passes see the same
ranges whatever executors are lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm import storage

#: Orders rows that are equal in key and order, so that however many there are they are dealt evenly.
CHANCE = "_chance"
_MARKS = [T.StructField("_part", T.IntegerType()), T.StructField("_open", T.BooleanType()), T.StructField("_edge", T.BooleanType())]


class Fold(NamedTuple):
    """``local(columns, place, start)``: the scan's values if every run began where it does in this batch.

    ``place`` is a row's place in its run, ``start`` the row at which that run begins.
    ``later(values, before)``: the values of rows whose run went on from ``before``, the values at
    the row ahead of the first of them. Values are int64 arrays, one for each of ``names``; the
    first is the row's place in its run, from 1.
    """

    names: tuple[str, ...]
    reads: tuple[str, ...]
    local: Callable[[list[np.ndarray], np.ndarray, np.ndarray], list[np.ndarray]]
    later: Callable[[list[np.ndarray], list[int]], list[np.ndarray]]


def in_order(df: DataFrame, keys: list, order: list) -> DataFrame:
    """``df`` range-partitioned and sorted by key, order and chance; ``_chance`` stays as a column."""
    chance = df.withColumn(CHANCE, F.rand(17))
    by = [*keys, *order, F.col(CHANCE)]
    return chance.repartitionByRange(*by).sortWithinPartitions(*by)


def changes(batch: pa.RecordBatch, keys: list[int]) -> np.ndarray:
    """Where a key differs from the row before; the first row counts as such."""
    new = np.ones(batch.num_rows, bool)
    new[1:] = False
    for k in keys:
        column = batch.column(k)
        here, before = column.slice(1), column.slice(0, batch.num_rows - 1)
        nulls = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
        new[1:] |= pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False) | (nulls[1:] != nulls[:-1])
    return new


def _local(keys: list[int], reads: list[int], fold: Fold):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_run, last, before = TaskContext.get().partitionId(), True, None, None
        waiting = None  # the newest batch: only once it is known to be the last is its last row an edge
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = changes(batch, keys)
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            start = starts[run]
            values = fold.local([batch.column(i).to_numpy(zero_copy_only=False) for i in reads], np.arange(n) - start, start)
            first = [batch.column(k)[0].as_py() for k in keys]
            opened = np.zeros(n, bool)
            edge = np.zeros(n, bool)
            edge[0] = last is None
            stop = int(starts[1]) if len(starts) > 1 else n
            if last is not None and first == last:
                values = [np.concatenate([a, v[stop:]]) for a, v in zip(fold.later([v[:stop] for v in values], before), values, strict=True)]
            elif last is not None:
                open_run = False
            if open_run:
                opened[:stop] = True
            open_run = open_run and len(starts) == 1
            last, before = [batch.column(k)[n - 1].as_py() for k in keys], [int(v[-1]) for v in values]
            if waiting is not None:
                yield waiting
            waiting = pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v, pa.int64()) for v in values), pa.array(np.full(n, part, np.int32)), pa.array(opened), pa.array(edge)],
                names=[*batch.schema.names, *fold.names, *(f.name for f in _MARKS)],
            )
        if waiting is not None:
            edge = waiting.column(waiting.num_columns - 1).to_numpy(zero_copy_only=False).copy()
            edge[-1] = True
            yield waiting.set_column(waiting.num_columns - 1, "_edge", pa.array(edge))

    return task


def scan(df: DataFrame, keys: list[str], order: list, fold: Fold, name: str) -> DataFrame:
    """``df`` (and ``_chance``) with the fold's columns, over each run of ``keys`` in ``order``; a written table.

    Null keys are a run of their own. An empty table gives an empty one.
    """
    sorted_rows = in_order(df, [F.col(k) for k in keys], order)
    names = sorted_rows.columns
    schema = T.StructType([*sorted_rows.schema.fields, *(T.StructField(n, T.LongType()) for n in fold.names), *_MARKS])
    table = storage.written(sorted_rows.mapInArrow(_local([names.index(k) for k in keys], [names.index(r) for r in fold.reads], fold), schema), name)
    edges = table.filter("_edge").select("_part", "_open", *keys, *fold.names, CHANCE).collect()  # two rows a task at most
    carried, last = {}, None
    for part in sorted({r._part for r in edges}):
        rows = [r for r in edges if r._part == part]
        # Of a task's two edges the first is in its open run; both are if that run is all it has.
        key = {k: next(r[k] for r in rows if r._open) for k in keys}
        if last is not None and last[0] == key:
            carried[part] = last[1]
        ends = [r for r in rows if not r._open]
        if ends:
            last = ({k: ends[0][k] for k in keys}, [ends[0][n] for n in fold.names])
        else:
            end = _furthest(rows, fold)
            if part in carried:
                end = [int(v[0]) for v in fold.later([np.array([x], np.int64) for x in end], carried[part])]
            last = (key, end)
    if not carried:
        return table.drop(*(f.name for f in _MARKS))
    plain = [*names, *fold.names]

    def adjust(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(len(plain)).to_numpy(zero_copy_only=False)
            opened = batch.column(len(plain) + 1).to_numpy(zero_copy_only=False)
            values = [batch.column(len(names) + i).to_numpy(zero_copy_only=False).copy() for i in range(len(fold.names))]
            for part in np.unique(parts[opened]):
                if (before := carried.get(int(part))) is not None:
                    at = np.flatnonzero(opened & (parts == part))
                    for v, x in zip(values, fold.later([v[at] for v in values], before), strict=True):
                        v[at] = x
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(v, pa.int64()) for v in values)], names=plain)

    return table.mapInArrow(adjust, T.StructType(schema.fields[: len(plain)]))


def _furthest(rows: list, fold: Fold) -> list[int]:
    """The values at the later of a task's edges: the first value of every fold is the row's place."""
    return max(([r[n] for n in fold.names] for r in rows), key=lambda v: v[0])


def place() -> Fold:
    """``place``: 1 for the first row of a run, 2 for the next."""
    return Fold(("place",), (), lambda columns, at, start: [at + 1], lambda values, before: [values[0] + before[0]])


def sums(*columns: str) -> Fold:
    """``place`` and the running sums ``sum_<column>`` of int64 columns."""

    def local(given, at, start):
        out = [at + 1]
        for c in given:
            total = np.concatenate([[0], np.cumsum(c)])
            out.append(total[1:] - total[start])
        return out

    return Fold(("place", *(f"sum_{c}" for c in columns)), columns, local, lambda values, before: [v + b for v, b in zip(values, before, strict=True)])


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2 ** 64 for every n, by squaring."""
    out, n, square = np.ones(len(n), np.uint64), n.copy(), base
    with np.errstate(over="ignore"):
        while n.any():
            out = np.where(n & 1, out * square, out)
            n, square = n >> 1, square * square
    return out


def prefix_fingerprints(column: str) -> Fold:
    """``place`` and ``print``, the polynomial of the run's values so far: print = print before * base + value, modulo 2 ** 64."""

    def local(given, at, start):
        value = given[0].view(np.uint64)
        i = np.arange(len(value))
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * _powers(_INVERSE, i), dtype=np.uint64)])
            found = (total[1:] - total[start]) * _powers(_BASE, i)
        return [at + 1, found.view(np.int64)]

    def later(values, before):
        with np.errstate(over="ignore"):
            moved = np.full(len(values[0]), before[1], np.int64).view(np.uint64) * _powers(_BASE, values[0])
            return [values[0] + before[0], (values[1].view(np.uint64) + moved).view(np.int64)]

    return Fold(("place", "print"), (column,), local, later)


def print_before(fingerprint: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The fingerprint without its last value."""
    with np.errstate(over="ignore"):
        return ((fingerprint.view(np.uint64) - value.view(np.uint64)) * _INVERSE).view(np.int64)


def last_marked(mark: str, *columns: str) -> Fold:
    """``place``, ``marked`` (1 once a row of the run with ``mark`` has been seen) and ``last_<column>`` at the newest such row, 0 before."""

    def local(given, at, start):
        i = np.arange(len(at))
        newest = np.maximum.accumulate(np.where(given[0].astype(bool), i, -1))
        seen = newest >= start
        return [at + 1, seen.astype(np.int64), *(np.where(seen, c[newest], 0) for c in given[1:])]

    def later(values, before):
        seen = values[1] > 0
        return [values[0] + before[0], np.where(seen, 1, before[1]), *(np.where(seen, v, b) for v, b in zip(values[2:], before[2:], strict=True))]

    return Fold(("place", "marked", *(f"last_{c}" for c in columns)), (mark, *columns), local, later)
