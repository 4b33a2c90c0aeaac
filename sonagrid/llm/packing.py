"""Vector bin packing of tokenised examples into training sequences.

A sequence has three limits: tokens, segments and loss-bearing tokens. Examples wait in a pool
of bounded size; an open sequence takes the waiting example whose demand has the largest dot
product with what the sequence has left (both as fractions of the limits), among those that
still fit. When none fits, the largest is cut to fill the sequence. What remains of a task in
the end is cut into sequences whose lengths are powers of two, which need no padding.

Each task packs the documents it reads: no shuffle, no key, memory bounded by the pool.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sonagrid.llm.pretokens import Pretokenizer, Pretokens, Remembered, runs
from sonagrid.llm.textarrays import blocks, lookup, released


class Limits(NamedTuple):
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048


class Piece(NamedTuple):
    example: int
    start: int
    length: int
    sequence: int
    offset: int


class VectorPacker:
    """Examples in, placed pieces out. ``cut_loss(example, start, length)`` gives a piece's loss-bearing tokens."""

    def __init__(self, limits: Limits, cut_loss, pool: int = 1024) -> None:
        self.limits, self.cut_loss, self.most = limits, cut_loss, pool
        self.capacity = np.array(limits, np.float64)
        self.waiting: list[tuple[int, int, int]] = []  # example, start, length
        self.sequence = 0

    def add(self, example: int, length: int) -> Iterator[Piece]:
        start = 0
        whole = self.limits.tokens
        while length - start >= whole and self.cut_loss(example, start, whole) <= self.limits.loss:
            yield Piece(example, start, whole, self._next(), 0)
            start += whole
        while length - start > whole:  # loss-bearing tokens bind: wait in pieces
            self.waiting.append((example, start, whole // 2))
            start += whole // 2
        if length > start:
            self.waiting.append((example, start, length - start))
        if len(self.waiting) >= self.most:
            yield from self._pack(self.most // 2)

    def finish(self) -> Iterator[Piece]:
        yield from self._pack(0)

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _pack(self, leave: int) -> Iterator[Piece]:
        items = self.waiting
        demand = np.array([(n, 1, self.cut_loss(e, s, n)) for e, s, n in items], np.float64).reshape(-1, 3)
        alive = np.ones(len(items), bool)
        while (left := int(alive.sum())) > leave:
            rest, placed = self.capacity.copy(), []
            while rest[0] > 0 and rest[1] > 0 and alive.any():
                score = demand @ (rest / self.capacity**2)
                fits = alive & (demand <= rest).all(axis=1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, score, -1)))
                    placed.append(items[k])
                    rest -= demand[k]
                    alive[k] = False
                    continue
                k = int(np.argmax(np.where(alive, demand[:, 0], -1)))
                e, s, n = items[k]
                take = min(int(rest[0]), n - 1)
                while take > 0 and self.cut_loss(e, s, take) > rest[2]:
                    take = min(take - 1, int(rest[2]))
                if take <= 0:
                    break
                placed.append((e, s, take))
                rest -= (take, 1, self.cut_loss(e, s, take))
                items[k] = (e, s + take, n - take)
                demand[k] = (n - take, 1, self.cut_loss(e, s + take, n - take))
            yield from self._place(placed)
            if left == int(alive.sum()) and not placed:  # a limit of nothing: one token a sequence can't be refused
                raise ValueError(f"no token fits under {self.limits}")
        self.waiting = [x for x, a in zip(items, alive, strict=True) if a]

    def _place(self, placed: list[tuple[int, int, int]]) -> Iterator[Piece]:
        """One full sequence, or several whose lengths are powers of two."""
        total = sum(n for _, _, n in placed)
        room, sequence, offset = 0, 0, 0
        for e, s, n in placed:
            while n:
                if not room:
                    room = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
                    total -= room
                    sequence, offset = self._next(), 0
                take = min(n, room)
                yield Piece(e, s, take, sequence, offset)
                s, n, room, offset = s + take, n - take, room - take, offset + take


class Encoder:
    """Token ids of whole texts; the tokenizers library encodes each pre-token, or chunk that byte classes can't cut, once a task."""

    def __init__(self, path: str, end_id: int | None, remembered: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread; the library's own threads each keep memory
        self.pre, self.end_id, self.remembered = Pretokenizer(path), end_id, remembered
        self.last = np.zeros(max(self.pre.vocab.values(), default=0) + 1, bool)  # ids that end a pre-token
        self.last[[i for token, i in self.pre.vocab.items() if token.endswith(self.pre.suffix)]] = True
        self.chunk_ids = Remembered(self._library)
        self._forget()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.pre.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.known, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, found: Pretokens, distinct: np.ndarray, first: np.ndarray) -> None:
        """The ids of those of ``distinct`` pre-tokens that aren't known; ``first`` is a place of each."""
        new = lookup(self.known, distinct) < 0
        fresh, place = distinct[new], first[new]
        if not len(fresh):
            return
        if len(self.known) + len(fresh) > self.remembered and len(self.known):
            self._forget()
            return self._learn(found, distinct, first)
        raw = found.data.tobytes()
        spans = list(zip(found.start[place].tolist(), found.end[place].tolist(), strict=True))
        # Pre-tokens apart by spaces are cut as they are; an id that ends a word ends a pre-token.
        texts = [b" ".join(raw[s:e] for s, e in spans[i : i + 2000]).decode("utf-8", "replace") for i in range(0, len(spans), 2000)]
        got = np.concatenate([np.array(x.ids, np.uint32) for x in self.pre.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.flatnonzero(self.last[got]) + 1
        size = np.diff(ends, prepend=0)
        if len(size) != len(spans):
            raise ValueError("the tokenizer's pre-tokens don't end with its suffix")
        start = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, got])
        keys = np.concatenate([self.known, fresh])
        order = np.argsort(keys, kind="stable")
        self.known, self.start, self.size = keys[order], np.concatenate([self.start, start])[order], np.concatenate([self.size, size])[order]

    def __call__(self, column: pa.Array) -> Iterator[np.ndarray]:
        """For each text its ids, as unsigned 32-bit numbers, and the end id."""
        for block in blocks(column):
            at, easy = self.pre.chunks(block)
            found = self.pre.cut(block, at, easy)
            distinct, first, back = np.unique(found.hash, return_index=True, return_inverse=True)
            self._learn(found, distinct, first)
            place = np.maximum(lookup(self.known, distinct), 0)[back]
            size, start = (self.size[place], self.start[place]) if len(self.known) else (np.zeros(0, np.int64),) * 2
            flat, text = self.flat, found.text
            if not easy.all():
                hard, which = self.chunk_ids(block.data, at.start[~easy], at.end[~easy])
                many = np.array([len(x) for x in hard], np.int64)
                order = np.argsort(np.concatenate([found.start, at.start[~easy]]), kind="stable")
                size = np.concatenate([size, many[which]])[order]
                start = np.concatenate([start, len(flat) + (np.cumsum(many) - many)[which]])[order]
                flat, text = np.concatenate([flat, *hard]), np.concatenate([text, at.text[~easy]])[order]
            ids = flat[runs(start, size)]
            per_text = np.bincount(text, size, len(block.bounds) - 1).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(per_text)])
            for i in range(len(block.bounds) - 1):
                own = ids[bounds[i] : bounds[i + 1]]
                yield own if self.end_id is None else np.append(own, np.uint32(self.end_id))


_PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens")


def _pack(rows: DataFrame, encoded, limits: Limits, with_ids: bool) -> DataFrame:
    """Pieces of examples; ``encoded`` yields (id, ids, running sum of loss-bearing ids) of a batch whose first column is the id."""
    key = rows.schema.fields[0]
    schema = T.StructType([T.StructField(key.name, key.dataType), *(T.StructField(n, T.LongType()) for n in _PIECES)])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}  # of examples that wait: id, ids, loss so far, ids not yet out

        def loss(example: int, start: int, length: int) -> int:
            upto = own[example][2]
            return length - (start == 0) if upto is None else int(upto[start + length] - upto[start])

        packer = VectorPacker(limits, loss)
        base, n = TaskContext.get().partitionId() << 32, 0
        out: list[tuple] = []
        id_kind = None

        def take(pieces: Iterator[Piece]) -> None:
            for p in pieces:
                doc, ids, _, left = own[p.example]
                part = ids[p.start : p.start + p.length]
                out.append((doc, p.start, p.length, zlib.crc32(part.astype("<u4").tobytes()), len(ids), base + p.sequence, p.offset, loss(p.example, p.start, p.length), part.astype(np.int32) if with_ids else None))
                if left == p.length:
                    del own[p.example]
                else:
                    own[p.example][3] = left - p.length

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 9
            out.clear()
            arrays = [pa.array(columns[0], id_kind), *(pa.array(x, pa.int64()) for x in columns[1:8])]
            return pa.RecordBatch.from_arrays([*arrays, *[pa.array(columns[8], pa.list_(pa.int32()))] * with_ids], names=schema.names)

        encode = encoded()
        for b in batches:
            id_kind = b.schema.field(0).type
            for doc, ids, upto in encode(b):
                if len(ids):
                    own[n] = [doc, ids, upto, len(ids)]
                    take(packer.add(n, len(ids)))
                    n += 1
                if len(out) > 1024:
                    yield batch()
        if id_kind is not None:
            take(packer.finish())
            yield batch()

    return rows.mapInArrow(released(run), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, placed in sequences.

    A document's ids are its text's, by the tokenizers library without special tokens, and then
    ``end_id``. Each id lies in exactly one piece. Every id bears loss but a document's first,
    which nothing precedes. Per piece: doc_id, start, length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), doc_tokens, sequence_id, offset, loss_tokens, and ids if
    ``with_ids``. Null and empty texts have the end id only; repeated rows are packed as often as
    they are; equal dot products are taken in the order of arrival; a null doc_id stays null; an
    empty table gives no pieces; other columns are not read.
    """

    def encoded():
        encoder = Encoder(tokenizer_path, end_id)
        return lambda b: ((doc, ids, None) for doc, ids in zip(b.column(0).to_pylist(), encoder(b.column(1)), strict=True))

    return _pack(docs.select("doc_id", "text"), encoded, limits, with_ids)


def pack_examples(examples: DataFrame, tokenizer_path: str, limits: Limits = Limits(), end_id: int = 1, with_ids: bool = False, key: str = "doc_id") -> DataFrame:
    """The pieces of instruction examples, of whose ids only some bear loss.

    ``parts`` (array<struct<text, loss>>) holds an example's turns in order; the ids of a part
    bear loss if its ``loss`` is true (null: false), and so does ``end_id``, which follows the last part, if that
    part does. An example's first id bears none. Columns are those of :func:`pack_documents`, with
    ``key`` for doc_id; null or empty parts have the end id only.
    """

    def encoded():
        encoder = Encoder(tokenizer_path, None)

        def run(b: pa.RecordBatch):
            parts = [x or [] for x in b.column(1).to_pylist()]
            ids = encoder(pa.array([x and x["text"] for p in parts for x in p], pa.string()))
            for name, own in zip(b.column(0).to_pylist(), parts, strict=True):
                bears = [bool(x and x["loss"]) for x in own]
                pieces = [*(next(ids) for _ in own), np.array([end_id], np.uint32)]
                mask = np.repeat([*bears, bool(bears and bears[-1])], [len(x) for x in pieces])
                mask[0] = False
                yield name, np.concatenate(pieces), np.concatenate([[0], np.cumsum(mask)])

        return run

    return _pack(examples.select(key, "parts"), encoded, limits, with_ids)
