"""Benchmark decontamination: a prefix-filtered set join of benchmark windows with documents.

A window is a set of shingles (four consecutive words). Shingles are ordered by how often they
stand in all documents; since a document must contain every shingle of a window, the necessary
prefix is one token: the rarest shingle. Each place of a prefix shingle in a document proposes
one window start, the bounds of the document cut starts that don't fit (position and length),
an item-sized hash leaves near-certain hits, and the words themselves decide.

Windows stay together in blocks of bounded size, each broadcast; a document passes all blocks
within one task, so nothing is shuffled and no key can be hot.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm.columns import carried, restored
from sonagrid.llm.textarrays import ALNUM, Block, LOWER, blocks, gram_hashes, lookup, released, span_hashes, words

SHINGLE = 4
#: Windows of one broadcast block: about 60 MB at 13 words each.
BLOCK_WINDOWS = 200_000


def _lowered(block: Block) -> Block:
    return block._replace(data=LOWER[block.data])


class WindowBlock:
    """Distinct windows of some benchmark items, and the index that finds them."""

    def __init__(self) -> None:
        self.items: dict[bytes, list[str]] = {}

    def add(self, item: str, text: str | None, size: int) -> None:
        for block in blocks(pa.array([text], pa.string())):
            block = _lowered(block)
            at = words(block, ALNUM)
            raw = block.data.tobytes()
            found = [raw[s:e] for s, e in zip(at.start.tolist(), at.end.tolist(), strict=True)]
            for i in range(max(len(found) - size, 0) + 1 if found else 0):
                have = self.items.setdefault(b" ".join(found[i : i + size]), [])
                if item not in have:
                    have.append(item)

    def freeze(self) -> WindowBlock:
        self.text = sorted(self.items)
        self.of = [self.items[x] for x in self.text]
        self.items = {}
        flat = [np.frombuffer(x, np.uint8) for x in self.text]
        self.length = np.array([x.count(b" ") + 1 for x in self.text], np.int64)
        self.hash = np.zeros(len(flat), np.uint64)
        shingles = []
        for i, data in enumerate(flat):
            at = words(Block(0, np.array([0, len(data)]), data), ALNUM)
            h = span_hashes(data, at.start, at.end)
            self.hash[i] = gram_hashes(h, len(h))[0]
            shingles.append(gram_hashes(h, min(SHINGLE, len(h))))
        self.shingles = shingles
        self.keys = np.unique(np.concatenate(shingles)) if shingles else np.zeros(0, np.uint64)
        return self

    def order(self, seen: dict[int, int]) -> WindowBlock:
        """Keep each window's rarest shingle; seen: how often the documents have shingle number i."""
        count = np.array([seen.get(i, 0) for i in range(len(self.keys))], np.int64)
        prefix: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, h in enumerate(self.shingles):
            k = lookup(self.keys, h)
            rarest = int(np.lexsort((k, count[k]))[0])
            prefix[int(h[rarest])].append((i, rarest))
        self.prefix = np.array(sorted(prefix), np.uint64)
        rows = [prefix[int(x)] for x in self.prefix]
        self.bounds = np.cumsum([0, *map(len, rows)])
        self.window = np.array([i for r in rows for i, _ in r], np.int64)
        self.offset = np.array([o for r in rows for _, o in r], np.int64)
        self.shingles, self.keys = [], np.zeros(0, np.uint64)
        return self

    def hits(self, block: Block, at, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(first word, length, window) of every occurrence; words counted over the block."""
        out = []
        raw = block.data.tobytes()
        for n in sorted({min(SHINGLE, int(x)) for x in np.unique(self.length)}):
            place = gram_hashes(hashes, n)
            key = lookup(self.prefix, place)
            place = np.flatnonzero(key >= 0)
            key = key[place]
            many = self.bounds[key + 1] - self.bounds[key]
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            row, place = np.repeat(self.bounds[key], many) + nth, np.repeat(place, many)
            window = self.window[row]
            start, text = place - self.offset[row], at.text[place]
            fits = (np.minimum(SHINGLE, self.length[window]) == n) & (start >= at.bounds[text]) & (start + self.length[window] <= at.bounds[text + 1])
            start, window = start[fits], window[fits]
            for length in np.unique(self.length[window]):
                own = self.length[window] == length
                s, w = start[own], window[own]
                whole = gram_hashes_at(hashes, s, int(length)) == self.hash[w]
                for a, b in zip(s[whole].tolist(), w[whole].tolist(), strict=True):
                    if b" ".join(raw[at.start[k] : at.end[k]] for k in range(a, a + int(length))) == self.text[b]:
                        out.append((a, int(length), b))
        return out


def gram_hashes_at(hashes: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """gram_hashes(hashes, n)[start], for those starts only."""
    return gram_hashes(hashes[start[:, None] + np.arange(n)].ravel(), n)[::n] if len(start) else np.zeros(0, np.uint64)


def window_blocks(benchmark: DataFrame, size: int, block_windows: int) -> list[WindowBlock]:
    """Blocks of at most ``block_windows`` windows (one item's at least); rows come one partition at a time."""
    out, own = [], WindowBlock()
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    for row in rows.toLocalIterator():
        own.add(row.item_id, row.text, size)
        if len(own.items) >= block_windows:
            out.append(own.freeze())
            own = WindowBlock()
    return [*out, own.freeze()] if own.items or not out else out


def _count(broadcast):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        sizes = sorted({min(SHINGLE, int(x)) for x in np.unique(own.length)})
        total = np.zeros(len(own.keys), np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                block = _lowered(block)
                at = words(block, ALNUM)
                hashes = span_hashes(block.data, at.start, at.end)
                for n in sizes:
                    key = lookup(own.keys, gram_hashes(hashes, n))
                    total += np.bincount(key[key >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    return count


def _mark(broadcast, first: bool):
    """Columns in: text, n_words, spans, items, ...; the same out, with this block's hits."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for batch in batches:
            n_words = np.zeros(batch.num_rows, np.int64)
            spans: list[list] = [[]] * batch.num_rows if first else batch.column(2).to_pylist()
            items: list[list] = [[]] * batch.num_rows if first else batch.column(3).to_pylist()
            for block in blocks(batch.column(0)):
                block = _lowered(block)
                at = words(block, ALNUM)
                n_words[block.first : block.first + len(at.bounds) - 1] = np.diff(at.bounds)
                found = defaultdict(list)
                for start, length, window in own.hits(block, at, span_hashes(block.data, at.start, at.end)) if len(own.prefix) else []:
                    text = int(at.text[start])
                    found[text].append((start - int(at.bounds[text]), length, window))
                for text, rows in found.items():
                    k = block.first + text
                    items[k] = sorted({*items[k], *(x for _, _, w in rows for x in own.of[w])})
                    merged: list[list[int]] = []
                    for s, e in sorted([*((x["first"], x["last"] + 1) for x in spans[k]), *((s, s + n) for s, n, _ in rows)]):
                        if merged and s <= merged[-1][1]:
                            merged[-1][1] = max(e, merged[-1][1])
                        else:
                            merged.append([s, e])
                    spans[k] = [{"first": s, "last": e - 1} for s, e in merged]
            kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip((n_words, spans, items), kinds, strict=True)), *(batch.column(i) for i in range(4, batch.num_columns))], names=batch.schema.names)

    return mark


_NEW = {"n_words": "long", "spans": "array<struct<first:long,last:long>>", "items": "array<string>"}


def marked(docs: DataFrame, benchmark: DataFrame, size: int = 13, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with what the benchmark's windows hit in each text.

    Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z went to lower case. A window
    is ``size`` consecutive words of an item; an item of fewer words, but not none, is one window.
    New columns (they replace columns of their names): n_words; spans, the merged runs of hit
    words (first and last word, from 0); items, the sorted ids of items with an occurring window;
    n_hit. Null texts have no words and no hits; null item ids or item texts have no windows;
    an empty benchmark hits nothing. Repeated rows are marked alike. Other columns pass through.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in (*_NEW, "text", "n_hit")]
    rows = docs.select("text", *(F.lit(None).cast(k).alias(c) for c, k in _NEW.items()), *others)
    schema = T.StructType(rows.schema.fields)
    for i, own in enumerate(window_blocks(benchmark, size, block_windows)):
        counting = spark.sparkContext.broadcast(own)
        counted = docs.select("text").mapInArrow(_count(counting), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
        seen = {r.shingle: r.n for r in counted.collect()} if len(own.keys) else {}  # at most one row a shingle of this block
        rows = rows.mapInArrow(released(_mark(spark.sparkContext.broadcast(own.order(seen)), i == 0)), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return rows.withColumn("n_hit", hit).select(*[c for c in docs.columns if c not in (*_NEW, "n_hit")], *_NEW, "n_hit")


def contaminated() -> F.Column:
    """Five per cent or more of the words are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = marked(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns."""
    found = marked(docs.select("text", carried(docs, "text").alias("row")), benchmark)
    return found.filter(~contaminated()).select(*restored(docs.columns, "row", "text"))
