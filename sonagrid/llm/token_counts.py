"""Token counts by rank-synchronous merging of ragged numpy arrays.

The distinct pre-tokens of a block that the task hasn't met yet lie in one flat array of
symbols. In every round each sequence finds its pair of lowest rank, and all places of that pair
merge at once, in all sequences; a sequence without a mergeable pair is done and leaves with the
number of symbols that survive. A merge can only make pairs of higher rank than its own, so this
ends as merging one place at a time does. Only maps over the input: no shuffle, no key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.llm.pretokens import Pretokenizer, Pretokens, new_spans
from sonagrid.llm.textarrays import blocks, lookup

_NONE = np.iinfo(np.int64).max
#: Pre-tokens a task remembers; past that it forgets them and starts again.
REMEMBERED = 2_000_000


class RankMerger:
    """Counts (and names) the symbols that byte-pair merging leaves of each pre-token."""

    def __init__(self, pre: Pretokenizer) -> None:
        v = pre.vocab
        self.inner = np.array([v[pre.char[b]] for b in range(256)], np.int64)
        self.last = np.array([v[pre.char[b] + pre.suffix] for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in pre.merges]
        self.size = len(v)
        key = np.array([v[a] * self.size + v[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.made = np.array([v[a + b] for a, b in pairs], np.int64)[order]

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Surviving symbols of each span."""
        length = end - start
        owner = np.repeat(np.arange(len(start)), length)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        raw = data[np.repeat(start, length) + at]
        symbols = np.where(at == length[owner] - 1, self.last[raw], self.inner[raw])
        counts = np.zeros(len(start), np.int64)
        while len(symbols):
            same = owner[:-1] == owner[1:]
            place = lookup(self.keys, np.where(same, symbols[:-1] * self.size + symbols[1:], -1))
            rank = np.append(np.where(place >= 0, self.ranks[place], _NONE), _NONE)
            heads = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(rank, heads)
            sizes = np.diff(np.append(heads, len(symbols)))
            done = lowest == _NONE
            counts[owner[heads[done]]] = sizes[done]
            here = (rank == np.repeat(lowest, sizes)) & (rank != _NONE)
            # A pair of twice one symbol can overlap itself: of a run of places every second merges.
            if (over := here[1:] & here[:-1]).any():
                place_of = np.arange(len(here))
                run = np.maximum.accumulate(np.where(here & ~np.append(False, over), place_of, 0))
                here &= (place_of - run) % 2 == 0
            merged = np.flatnonzero(here)
            symbols[merged] = self.made[place[merged]]
            stays = np.repeat(~done, sizes)
            stays[merged + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        return counts


class Counter:
    """Token counts of whole texts; remembers the pre-tokens it has merged."""

    def __init__(self, path: str) -> None:
        self.pre = Pretokenizer(path)
        self.merger = RankMerger(self.pre)
        self.known, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column), np.int64)
        for block in blocks(column):
            found = self.pre(block)
            n = self.counts(found)
            out[block.first : block.first + len(block.bounds) - 1] = np.bincount(found.text, n, len(block.bounds) - 1).astype(np.int64)
        return out

    def counts(self, found: Pretokens) -> np.ndarray:
        fresh, place = new_spans(found, self.known)
        if len(fresh) and len(self.known) and len(self.known) + len(fresh) > REMEMBERED:
            self.known, self.sizes = self.known[:0], self.sizes[:0]
            return self.counts(found)
        if len(fresh):
            sizes = self.merger.merge(found.data, found.start[place], found.end[place])
            keys = np.concatenate([self.known, fresh])
            order = np.argsort(keys, kind="stable")
            self.known, self.sizes = keys[order], np.concatenate([self.sizes, sizes])[order]
        return self._once(found, self.known, self.sizes)

    def _once(self, found: Pretokens, keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.ones(len(found.hash), np.int64)
        return np.where(found.special >= 0, 1, sizes[np.maximum(lookup(keys, found.hash), 0)])


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    Counts are those of the tokenizers library without begin, end or added special tokens;
    special strings inside a text count as its default has it (one token each). Null texts are
    empty: 0 bytes, 0 tokens. Repeated rows come out as often as they are; a null doc_id stays
    null; an empty table gives an empty result; other columns are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter(batch.column(2)))], names=["doc_id", "n_bytes", "n_tokens"])

    rows_in = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows_in.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
