"""Near-duplicate detection by Order MinHash, verified by banded alignment.

k-mers are five consecutive words, labelled by their occurrence within the text. For each of
``sketches`` hash functions the ``taken`` smallest k-mers are retained in text order; their hash is
one bucket key. So two texts meet in a bucket if they share those k-mers in the same order.

Texts with the same words are one node, so copies are never paired. First every node is compared
with the leader of its largest bucket (the member with the least hash), then with one leader of each
other component that leads one of its buckets; that joins most of what belongs together.
In a bucket that is still of several components the nodes outside its largest one meet two more
nodes of that. Of what stays apart, all buckets with the same largest component are one unit, if
that repeats fewer rows, or else each is a unit. A unit is cut into tiles of bounded size: each
tile of nodes outside its largest component meets every other tile in one group, where the pairs
of different components that share a bucket are verified. Tiles of the largest component never
meet one another, so few rows are repeated. Only links leave a group, never pairs; every pair of a
bucket is either joined or verified, whatever the bucket's size.

A pair is verified on its whole texts: the longest chain of common k-mers that stand in the same
order in both, within a band around the diagonal as wide as the threshold allows, aligns their
words. What lies between the chain's k-mers counts as edited, at the length of its longer side; the
edit similarity is one less the edited share of the longer text. The link holds if that reaches
``threshold`` and the chain has at least ``shared`` of all k-mers: less alike pairs too may meet in
a bucket, but Order MinHash can't promise it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm import storage
from sonagrid.llm.columns import carried, restored
from sonagrid.llm.textarrays import Block, NOT_BLANK, blocks, gram_hashes, lookup, mix, released, span_hashes, words

#: Tables of so many rows of one or two numbers are broadcast; longer ones are shuffled.
BROADCAST_ROWS = 500_000
#: Parts into which the nodes of a bucket are dealt where it is joined by shuffling.
SALTS = 16


class Settings(NamedTuple):
    threshold: float = 0.8
    shared: float = 0.4
    shingle: int = 5
    sketches: int = 32
    taken: int = 3
    tile: int = 512


def labelled_kmers(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k-mer hashes in text order, bounds per text, hashes of words with their bounds' text)."""
    at = words(block, NOT_BLANK)
    h = span_hashes(block.data, at.start, at.end)
    n_words = np.diff(at.bounds)
    n = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(n)])
    text = np.repeat(np.arange(len(n)), n)
    start = np.repeat(at.bounds[:-1], n) + np.arange(len(text)) - bounds[:-1][text]
    grams = np.zeros(len(text), np.uint64)
    whole = n_words[text] >= size
    grams[whole] = gram_hashes(h, size)[start[whole]] if whole.any() else grams[whole]
    for i in np.flatnonzero((n_words > 0) & (n_words < size)).tolist():  # one k-mer of all words
        own = h[at.bounds[i] : at.bounds[i + 1]]
        grams[bounds[i]] = gram_hashes(own, len(own))[0]
    # The k-th place of a k-mer within its text has label k.
    order = np.lexsort((grams, text))
    t, g = text[order], grams[order]
    new = np.ones(len(order), bool)
    new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    place = np.arange(len(order))
    nth = np.zeros(len(order), np.int64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    repeated = nth > 0
    grams[repeated] = mix(grams[repeated] + mix(nth[repeated].astype(np.uint64)))
    return grams, bounds, h


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def order_minhash(grams: np.ndarray, bounds: np.ndarray, sketches: int, taken: int) -> np.ndarray:
    """One row of sketch values per text; texts without k-mers have zeros."""
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    out = np.zeros((len(n), sketches), np.uint64)
    # Below this value lie 4 * taken k-mers of a text on average: enough, or else the text is looked at whole.
    share = np.minimum(4.0 * taken / np.maximum(n, 1), 1.0)
    limit = np.where(share >= 1, np.uint64(2**64 - 1), (share * 2.0**63).astype(np.uint64) * np.uint64(2))[text]
    need = np.minimum(n, taken)
    odd = mix(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    for j in range(sketches):
        with np.errstate(over="ignore"):
            value = (grams ^ mix(odd[j : j + 1])) * odd[j]
            value ^= value >> np.uint64(29)
            value *= np.uint64(0x9E3779B97F4A7C15)
        some = np.flatnonzero(value <= limit)
        few = np.flatnonzero(np.bincount(text[some], minlength=len(n)) < need)
        if len(few):
            some = np.unique(np.concatenate([some, *(np.arange(bounds[i], bounds[i + 1]) for i in few.tolist())]))
        order = some[np.lexsort((value[some], text[some]))]
        t = text[order]
        nth = np.arange(len(t)) - np.searchsorted(t, t)
        chosen = np.sort(order[nth < taken])  # back in text order
        t = text[chosen]
        nth = np.arange(len(t)) - np.searchsorted(t, t)
        h = np.full(len(n), j + 1, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(taken):
                own = nth == k
                h[t[own]] = h[t[own]] * np.uint64(0x9E3779B97F4A7C15) + mix(grams[chosen[own]])
        out[:, j] = np.where(n > 0, mix(h), 0)
    return out


def _sequence_hashes(h: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's word sequence."""
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    text = np.repeat(np.arange(len(n_words)), n_words)
    place = (np.arange(len(h)) - bounds[:-1][text]).astype(np.uint64)
    with np.errstate(over="ignore"):
        parts = (mix(h + mix(place)), mix((h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(3) + mix(~place)))
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(p)]) for p in parts]
        return tuple(mix(s[bounds[1:]] - s[bounds[:-1]] + n_words.astype(np.uint64)) for s in sums)


def _sketch(s: Settings):
    """Columns in: text, others. Out: text, h1, h2, sketch, size (k-mers), others."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                yield from sketched(batch)

    def sketched(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in blocks(_lowered(batch.column(0))):
            texts = len(block.bounds) - 1
            grams, bounds, h = labelled_kmers(block, s.shingle)
            n_words = np.diff(words(block, NOT_BLANK).bounds)
            h1, h2 = _sequence_hashes(h, n_words)
            sketch = order_minhash(grams, bounds, s.sketches, s.taken)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n_words > 0, s.sketches, 0))]).astype(np.int32)), pa.array(sketch[n_words > 0].ravel().view(np.int64)))
            columns = [c.slice(block.first, texts) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), lists, pa.array(np.diff(bounds)), *columns[1:]], names=[batch.schema.names[0], "h1", "h2", "sketch", "size", *batch.schema.names[1:]])

    return rows


def _longest_rise(places: np.ndarray) -> np.ndarray:
    """Indices of a longest strictly ascending run of ``places``."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return np.arange(len(places))
    tails: list[int] = []  # the lowest end of a run of each length, and where it stands
    at_tail: list[int] = []
    before = np.full(len(places), -1)
    for i, p in enumerate(places.tolist()):
        at = bisect_left(tails, p)
        if at:
            before[i] = at_tail[at - 1]
        if at == len(tails):
            tails.append(p)
            at_tail.append(i)
        else:
            tails[at], at_tail[at] = p, i
    run, i = [], at_tail[-1]
    while i >= 0:
        run.append(i)
        i = int(before[i])
    return np.array(run[::-1])


def aligned_similarity(a: np.ndarray, b: np.ndarray, s: Settings) -> float:
    """Edit similarity of two texts' words by the chain of their common k-mers; 0 if it can't reach what ``s`` asks.

    k-mers are distinct within each text, so the chain is a longest common subsequence, found as
    the longest ascending run of places.
    """
    if (len(a), int(a[0]), int(a[-1])) > (len(b), int(b[0]), int(b[-1])):
        a, b = b, a  # the same alignment whichever comes first
    longer = len(b) + s.shingle - 1
    most = (1 - s.threshold) * longer + 1e-9  # edited words
    need = s.shared / (1 + s.shared) * (len(a) + len(b)) - 1e-9
    if len(b) - len(a) > most or len(a) < need:
        return 0.0
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(ia - ib) <= most
    ia, ib = ia[near], ib[near]
    if len(ia) < need:
        return 0.0
    order = np.argsort(ia)
    ia, ib = ia[order], ib[order]
    run = _longest_rise(ib)
    if len(run) < need:
        return 0.0
    ia, ib = ia[run], ib[run]
    da, db = np.diff(ia), np.diff(ib)
    between = np.maximum(da, db) - np.minimum(np.minimum(da, db), s.shingle)
    edited = max(ia[0], ib[0]) + between.sum() + max(len(a) - 1 - ia[-1], len(b) - 1 - ib[-1])
    return float(1 - edited / longer) if edited <= most else 0.0


def _needed(size: np.ndarray, a: np.ndarray, b: np.ndarray, s: Settings) -> np.ndarray:
    """Common k-mers without which a pair is no link; more than any text has if the lengths differ too much."""
    apart = np.abs(size[a] - size[b]) > (1 - s.threshold) * (np.maximum(size[a], size[b]) + s.shingle - 1) + 1e-9
    return np.where(apart, np.inf, s.shared / (1 + s.shared) * (size[a] + size[b]) - 1e-9)


def pair_overlaps(kmers: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common k-mers of the pairs (a[i], b[i]), places in ``kmers``; a ascending."""
    size = np.array([len(k) for k in kmers], np.int64)
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    heads = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])).tolist()
    for s, e in zip(heads, [*heads[1:], len(a)], strict=True):
        others = b[s:e]
        common = lookup(np.sort(kmers[a[s]]), np.concatenate([kmers[i] for i in others])) >= 0
        out[s:e] = np.add.reduceat(common.astype(np.int64), np.cumsum(size[others]) - size[others])  # texts here have k-mers
    return out


def all_overlaps(kmers: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Common k-mers of every two texts of a tile: products of the marks of k-mers that several texts have."""
    n = len(kmers)
    out = np.zeros((n, n), np.float32)
    gram, owner = np.concatenate(kmers), np.repeat(np.arange(n), [len(k) for k in kmers])
    _, column, times = np.unique(gram, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner = owner[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        s, e = np.searchsorted(column, [first, first + columns])
        marks = np.zeros((n, min(columns, int(column[-1]) + 1 - first)), np.float32)
        marks[owner[s:e], column[s:e] - first] = 1
        out += marks @ marks.T
    return out


def holding(kmers: list[np.ndarray], a: np.ndarray, b: np.ndarray, common: np.ndarray, s: Settings) -> Iterator[tuple[int, int, float]]:
    """Those pairs whose alignment is a link; only pairs with enough common k-mers are aligned."""
    size = np.array([len(k) for k in kmers], np.int64)
    for i in np.flatnonzero(common >= _needed(size, a, b, s)).tolist():
        found = aligned_similarity(kmers[a[i]], kmers[b[i]], s)
        if found:
            yield int(a[i]), int(b[i]), found


_LINK = "a long, b long, similarity double"


def _links(nodes: list[int], found: Iterator[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*((min(nodes[x], nodes[y]), max(nodes[x], nodes[y]), z) for x, y, z in found), strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["a", "b", "similarity"])


def _kmers(texts: pa.Array, s: Settings) -> list[np.ndarray]:
    out = []
    for block in blocks(_lowered(texts)):
        grams, bounds, _ = labelled_kmers(block, s.shingle)
        out += np.split(grams, bounds[1:-1])
    return out


def _verify(s: Settings):
    """Columns in: a, b, text_a, text_b. Out: the pairs that hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):  # a bounded number of texts at a time
                batch = whole.slice(start, 256)
                ids = np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
                nodes, first, place = np.unique(ids, return_index=True, return_inverse=True)
                texts = pa.concat_arrays([batch.column(2), batch.column(3)]).take(pa.array(first))
                kmers, n = _kmers(texts, s), batch.num_rows
                size = np.array([len(k) for k in kmers], np.int64)
                a, b = place[:n], place[n:]
                near = np.minimum(size[a], size[b]) >= _needed(size, a, b, s)
                a, b = a[near], b[near]
                order = np.argsort(a, kind="stable")
                a, b = a[order], b[order]
                yield _links(nodes.tolist(), holding(kmers, a, b, pair_overlaps(kmers, a, b), s))
        pa.default_memory_pool().release_unused()

    return rows


def _verify_tiles(s: Settings):
    """One group: the nodes of two tiles of a unit. Out: the links between them, and once a tile those within it.

    A pair is verified in its first bucket (of number ``j``) if that is a unit, and in every unit of several buckets.
    """

    def rows(table: pa.Table) -> pa.Table:
        left = table["tile"].to_numpy() == table["p"].to_numpy()
        within = table["q"][0].as_py() == table["mains"][0].as_py()  # a tile meets the first of the largest component once
        sketch = np.stack(table["sketch"].to_pylist())
        comp, size, j = table["comp"].to_numpy(), table["size"].to_numpy(), table["j"][0].as_py()
        pairs_a, pairs_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        left, right = np.flatnonzero(left), np.flatnonzero(~left)
        for at, i in enumerate(left.tolist()):
            others = np.concatenate([left[at + 1 :], right]) if within else right
            others = others[comp[others] != comp[i]]
            same = sketch[others] == sketch[i]
            good = others[same.any(axis=1) if j is None else ~same[:, :j].any(axis=1)]
            good = good[np.minimum(size[i], size[good]) >= _needed(size, np.full(len(good), i), good, s)]
            pairs_a.append(np.full(len(good), i))
            pairs_b.append(good)
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        if not len(a):
            return pa.Table.from_batches([_links([], iter(()))])
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = place[: len(a)], place[len(a) :]
        texts = table["text"].combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        kmers = _kmers(texts.take(pa.array(used)), s)
        found = holding(kmers, a, b, all_overlaps(kmers)[a, b], s)
        nodes = table["node"].to_numpy()[used].tolist()
        out = pa.Table.from_batches([_links(nodes, found)])
        pa.default_memory_pool().release_unused()
        return out

    return rows


def _short(df: DataFrame) -> bool:
    """Whether a written table is short enough for a broadcast."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _sized(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is short; it must be a written table."""
    return F.broadcast(df) if _short(df) else df


def _dealt(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``many`` (with ``node``) joined to a written table of keys, without one task for all rows of a key.

    A short table is broadcast; a longer one is repeated for ``SALTS`` parts of each key.
    """
    if _short(few):
        return many.join(F.broadcast(few), key)
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(SALTS)).cast("int")).join(salted, [key, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge table (a, b): root is the smallest node it is joined to.

    Alternates large stars and small stars until every node but the roots has one edge, to a root;
    every state is a written table.
    """

    def stars(df: DataFrame) -> bool:
        inner = df.join(df.select(F.col("v").alias("u")), "u", "left_semi").select("u")
        return inner.unionByName(df.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")).isEmpty()

    now = storage.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        following = storage.written(small.distinct(), "stars")
        storage.delete(now)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _placed(rows: DataFrame, roots: DataFrame | None, node: str, name: str) -> DataFrame:
    """``rows`` with the component of a node; nodes without links are their own."""
    if roots is None:
        return rows.withColumn(name, F.col(node))
    of = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(_sized(of), node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """(node, root) once ``links`` join components; only links between components are followed."""
    if roots is None:
        return components(links)
    lifted = _placed(_placed(links.select("a", "b"), roots, "a", "x"), roots, "b", "y").filter("x <> y")
    lifted = storage.written(lifted.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "lifted")
    if lifted.isEmpty():
        return roots
    up = components(lifted)
    moved = _placed(roots.withColumnRenamed("root", "old"), up, "old", "root").select("node", "root")
    return storage.written(moved.unionByName(up), "roots")


def _classes(nodes: DataFrame, texts: DataFrame, s: Settings) -> DataFrame:
    """(node, root) of nodes joined by links; nodes: node, sketch; texts: row, text, sketch, size."""
    keyed = nodes.select("node", F.posexplode("sketch").alias("j", "value")).select(F.xxhash64("j", "value").alias("bucket"), "node", "j")
    leader = F.min(F.struct(F.xxhash64(F.lit(1), "node").alias("h"), "node"))["node"]
    buckets = storage.written(keyed.groupBy("bucket").agg(F.count("*").alias("n"), leader.alias("leader")).filter("n > 1"), "buckets")
    members = storage.written(_dealt(keyed, buckets, "bucket"), "members")
    wanted = storage.written(members.select(F.col("node").alias("row")).distinct(), "wanted")
    texts = storage.written(texts.join(_sized(wanted), "row").select(F.col("row").alias("node"), "text", "sketch", "size"), "texts")
    storage.delete(wanted)

    def verified(pairs: DataFrame) -> DataFrame:
        ends = [texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
        return storage.written(pairs.join(ends[1], "b").join(ends[0], "a").select("a", "b", "text_a", "text_b").mapInArrow(released(_verify(s)), _LINK), "links")

    # A node meets the leader of its largest bucket, then one leader of each other component that leads one of its buckets.
    others = members.filter("node <> leader")
    first = others.groupBy("node").agg(F.max_by("leader", F.struct("n", "bucket")).alias("leader"))
    roots = _joined(None, verified(first.select(F.col("node").alias("a"), F.col("leader").alias("b"))))
    led = storage.written(_placed(buckets.select("bucket", "leader"), roots, "leader", "other").select("bucket", "other"), "led")
    apart = _placed(_dealt(others.select("bucket", "node", "leader"), led, "bucket"), roots, "node", "comp").filter("comp <> other")
    second = apart.groupBy("node", "other").agg(F.min("leader").alias("leader"))
    roots = _joined(roots, verified(second.select(F.col("node").alias("a"), F.col("leader").alias("b"))))

    def several(members: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members with their components, and the buckets of several with the largest of these and two nodes of it."""
        rest = storage.written(_placed(members, roots, "node", "comp"), "rest")
        by = F.struct(F.xxhash64(F.lit(4), "node").alias("h"), "node")
        parts = rest.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.array(F.min(by)["node"], F.max(by)["node"]).alias("leaders"))
        found = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp", "leaders")).alias("main")).filter(F.col("n") > F.col("main.n"))
        return rest, storage.written(found.select("bucket", F.col("main.comp").alias("main"), "main.leaders", F.col("main.n").alias("inside"), (F.col("n") - F.col("main.n")).alias("outside")), "mixed")

    rest, mixed = several(members.select("bucket", "node", "j"))
    third = _dealt(rest, mixed, "bucket").filter("comp <> main").select(F.col("node").alias("a"), F.explode("leaders").alias("b")).distinct()
    roots = _joined(roots, verified(third))
    rest, mixed = several(_dealt(rest.select("bucket", "node", "j"), mixed.select("bucket"), "bucket"))
    # A unit is all buckets with the same largest component, or one bucket, whichever way has fewer rows.
    inside = F.col("comp") == F.col("main")
    once = storage.written(_dealt(rest, mixed.select("bucket", "main"), "bucket").select("main", "node", "comp").distinct(), "once")
    tiles, others = (F.ceil(F.col(c) / s.tile).cast("int") for c in ("inside", "outside"))
    made = F.col("inside") * others + F.col("outside") * (tiles + others - 1)
    whole = once.groupBy("main").agg(F.count(F.when(inside, 1)).alias("inside"), F.count(F.when(~inside, 1)).alias("outside"))
    apart = mixed.groupBy("main").agg(F.sum(made).alias("apart"))
    ways = storage.written(whole.join(apart, "main").select("main", (made <= F.col("apart")).alias("whole"), others.alias("mains"), tiles.alias("tiles")), "ways")
    of_bucket = storage.written(mixed.join(_sized(ways), "main").filter("not whole").select("bucket", "main", others.alias("mains"), tiles.alias("tiles")), "units")
    dealt = _dealt(once, ways.filter("whole").drop("whole"), "main").select("*", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("int").alias("j"))
    dealt = dealt.unionByName(_dealt(rest, of_bucket, "bucket"))
    # Tiles below ``mains`` hold the nodes outside the largest component.
    at = F.xxhash64(F.lit(2), "node")
    tile = F.when(inside, F.col("mains") + F.pmod(at, "tiles")).otherwise(F.pmod(at, "mains")).cast("int")
    last = F.when(inside, F.col("mains")).otherwise(F.col("mains") + F.col("tiles")) - 1
    dealt = dealt.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), last))).filter("other <> tile")
    dealt = dealt.select("main", "bucket", "node", "j", "comp", "mains", "tile", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"))
    return _joined(roots, storage.written(dealt.join(texts, "node").groupBy("main", "bucket", "p", "q").applyInArrow(_verify_tiles(s), _LINK), "more-links"))


def classed(docs: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): the rows of ``docs`` with a row number, and each row's class.

    rows: row, text, rest (a struct of the other columns); marks: row, class, class_docs, first.
    Documents are in one class if their words are the same (white space and case aside) or a chain
    of verified links joins them. class is the smallest doc_id of the class (null if none has
    one), class_docs the number of its documents, first is true for one row of each class, one
    that has that doc_id (ties: any one of them). Texts of fewer than five words are one k-mer. Texts without words are
    one class if they aren't null; a null text is a class of its own. Repeated rows share a class.
    An empty table gives an empty result; other columns pass through in rest, whatever their names.
    Both are written tables; all that is written on the way to them is deleted.
    """
    with storage.scratch() as tables:
        inner = docs.select("text", carried(docs, "text").alias("rest"))
        schema = T.StructType([inner.schema["text"], *(T.StructField(c, T.LongType()) for c in ("h1", "h2")), T.StructField("sketch", T.ArrayType(T.LongType())), T.StructField("size", T.LongType()), inner.schema["rest"]])
        rows = storage.written(inner.mapInArrow(released(_sketch(settings)), schema).withColumn("row", F.monotonically_increasing_id()), "sketches")
        # A null text is a node of its own: its row stands in for the hashes.
        key = [F.when(F.col("text").isNull(), F.col("row")).otherwise(F.col("h1")).alias("h1"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("h2")).alias("h2")]
        ids = rows.select(*key, "row", F.col("rest")["doc_id"].cast("long").alias("doc_id"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        nodes = storage.written(ids.groupBy("h1", "h2").agg(F.min("row").alias("node"), F.min(order).alias("least"), F.count("*").alias("n")), "nodes")
        sketched = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").filter(F.size("sketch") > 0).select(F.col("row").alias("node"), "sketch")
        sketched = storage.written(sketched, "node-sketches")
        roots = _classes(sketched, rows.select("row", "text", "sketch", "size"), settings)
        # Nodes without links are their own class; only the others are summed by root.
        linked = nodes.join(roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "node")
        linked = storage.written(linked, "linked")
        classes = linked.groupBy("root").agg(F.min("least").alias("all_least"), F.sum("n").alias("all_n"))
        shared = _dealt(linked, storage.written(classes, "classes"), "root").select("h1", "h2", F.col("all_least").alias("least"), F.col("all_n").alias("n"))
        alone = nodes.join(_sized(linked.select("node")), "node", "left_anti").select("h1", "h2", "least", "n")
        of = shared.unionByName(alone).select("h1", "h2", F.col("least.doc_id").alias("class"), F.col("n").alias("class_docs"), F.col("least.row").alias("first_row"))
        of = storage.written(of, "class-of")
        marks = ids.join(of, ["h1", "h2"]).select("row", "class", "class_docs", (F.col("row") == F.col("first_row")).alias("first"))
        marks = storage.written(marks, "marks")
        tables.keep(rows, marks)
    return rows, marks


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, class_id, class_docs and representative of every document; see :func:`classed`."""
    with storage.scratch() as tables:
        rows, marks = classed(docs.select("doc_id", "text"), settings)
        ids = rows.select("row", F.col("rest")["doc_id"].alias("doc_id"))
        out = storage.written(ids.join(marks, "row").select("doc_id", F.col("class").alias("class_id"), "class_docs", F.col("first").alias("representative")), "near-duplicates")
        tables.keep(out)
    return out


def without_near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row of each class, with the columns of ``docs``; see :func:`classed`."""
    rows, marks = classed(docs, settings)
    gone = _sized(storage.written(marks.filter(~F.col("first")).select("row"), "gone"))
    return rows.select("row", "text", "rest").join(gone, "row", "left_anti").select(*restored(docs.columns, "rest", "text"))
