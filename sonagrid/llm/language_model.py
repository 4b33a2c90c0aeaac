"""Language-model scores by a weighted backoff automaton.

Counts come from all training texts. The automaton's states are the empty history, words, and
pairs of words; an arc carries a smoothed log-probability, and a failure arc carries the weight of
backing off to the next shorter history. Every n-gram of at least two training places is an arc,
however large the corpus is: words and arcs are tables in the shared folder that grow with it.

What the automaton adds up along a text is regrouped by n-gram: a word brings its unigram and its
failure arc, a pair or triple brings its arc less the way round it (the failure arc of its history
and the arc of its shorter n-gram) and, for a pair, its own failure arc. So a text's score is the
sum of one weight for each word, pair and triple that it holds, and n-grams without arcs bring 0.

Frequent words and n-grams are scored where they stand, from a broadcast of at most 1 / share of
them; the others are dealt by ranges of their hashes, each range to one task, and meet the weights of that
range there. Since frequent ones are not dealt, no range is hot.

N-grams are dealt in ``TURNS`` turns, each a share of their hashes, and what a turn shuffled goes
before the next: all n-grams are counted and scored, but only a share of them lies on disk at once. So
that turns don't cut texts into words again, the words' numbers are written first, compressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm import storage
from sonagrid.llm.textarrays import LOWER, NOT_BLANK, Block, blocks, lookup, mix, span_hashes, words

#: The key of the end token; words never have it.
END = np.uint64(0)
#: Distinct keys a task gathers before it sends them on.
GATHERED = 1_000_000
#: Pairs, and as many triples, that a task gathers before it deals them.
DEALT = 1 << 20
#: Tokens whose n-grams would fill a range of hashes in one turn, about.
RANGE_TOKENS = 1 << 20
#: Turns in which n-grams are dealt.
TURNS = 4
_ODD = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
#: Bits of a frequent word's number; three of them make one key.
_BITS = np.uint64(21)


class Shares(NamedTuple):
    hot: float = 5e-7  # words scored where they stand: 2,000,000 at most
    word: float = 0.0  # least share of a word in arcs; two places at any rate
    arc: float = 0.0  # least share of an arc; two places at any rate
    gram: float = 2e-6  # pairs and triples scored where they stand: 500,000 of each at most


class Index(NamedTuple):
    """Hashes and where each of their leading bits begins: few steps find one, unlike a binary search."""

    keys: np.ndarray  # ascending, then the largest number there is
    starts: np.ndarray
    shift: np.uint64


class Frequent(NamedTuple):
    """Words that n-grams are sent with by number: the more places, the smaller."""

    index: Index
    number: np.ndarray  # of each of the index's keys
    words: np.ndarray  # by number


class Automaton(NamedTuple):
    """What is scored where it stands: words by their number, n-grams by their place in the index."""

    unigram: np.ndarray  # log10
    known: np.ndarray  # bool: seen in training
    fail: np.ndarray  # log10 weight of the failure arc of a word's state
    grams: Index
    weights: np.ndarray


def index(keys: np.ndarray) -> Index:
    """Of ascending, distinct hashes."""
    bits = max(1, len(keys).bit_length())
    starts = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
    return Index(np.append(keys, ~np.uint64(0)), starts, np.uint64(64 - bits))


def places_in(index: Index, wanted: np.ndarray) -> np.ndarray:
    """:func:`lookup` in an index."""
    at = index.starts[wanted >> index.shift]
    late = np.flatnonzero(index.keys[at] < wanted)
    while len(late):
        at[late] += 1
        late = late[index.keys[at[late]] < wanted[late]]
    return np.where((index.keys[at] == wanted) & (at < len(index.keys) - 1), at, -1)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every token of a block: the words of each text and then its end."""
    data = LOWER[block.data]
    at = words(block._replace(data=data), NOT_BLANK)
    h = span_hashes(data, at.start, at.end)
    h[h == END] = np.uint64(1)
    ends = at.bounds[1:]
    return np.insert(at.text, ends, np.arange(len(ends))), np.insert(h, ends, END)


class _Gather:
    """Counts by key until there are too many keys."""

    def __init__(self) -> None:
        self.keys, self.counts, self.n = [], [], 0

    def add(self, keys: np.ndarray, weights: np.ndarray) -> None:
        distinct, back = np.unique(keys, return_inverse=True)
        self.keys.append(distinct)
        self.counts.append(np.stack([np.bincount(back, w, len(distinct)).astype(np.int64) for w in weights], axis=1))
        self.n += len(distinct)
        if self.n > GATHERED:
            self._shrink()

    def _shrink(self) -> None:
        if len(self.keys) > 1:
            distinct, back = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.concatenate(self.counts)
            self.keys, self.counts = [distinct], [np.stack([np.bincount(back, counts[:, i], len(distinct)).astype(np.int64) for i in range(counts.shape[1])], axis=1)]
            self.n = len(distinct)

    def full(self) -> bool:
        return self.n > GATHERED

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        self._shrink()
        keys, counts = (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.uint64), np.zeros((0, 2), np.int64))
        self.__init__()
        return keys, counts


def _unigrams(ranges: int):
    """Counts of words in training and other texts, summed within the task and dealt by ranges of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys, counts = gather.drain()
            return pa.RecordBatch.from_arrays(_deal(keys, ranges, keys, counts[:, 0], counts[:, 1]), names=["part", "word", "training", "other"])

        gather = _Gather()
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                text, key = tokens(block)
                other = held[block.first + text].astype(np.float64)
                gather.add(key, np.stack([1 - other, other]))
                if gather.full():
                    yield out()
        if gather.n:
            yield out()

    return run


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, training, other) counts of one range; its rows are summed each time they have doubled."""
    held: list[tuple[np.ndarray, ...]] = []
    n = distinct = 0

    def shrink() -> None:
        word, *counts = (np.concatenate(x) for x in zip(*held, strict=True))
        word, _, counts = _summed(word, [], counts)
        held[:] = [(word, *counts)]

    for batch in batches:
        for word, training, other in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            held.append((np.frombuffer(word, np.uint64), np.frombuffer(training, np.int64), np.frombuffer(other, np.int64)))
            n += len(held[-1][0])
            if n > max(GATHERED, 2 * distinct):
                shrink()
                n = distinct = len(held[0][0])
    if held:
        shrink()
        key, training, other = held[0]
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(training), pa.array(other)], names=["word", "training", "other"])


def gram_keys(first: np.ndarray, second: np.ndarray, order: int) -> np.ndarray:
    """Hashes of n-grams: of two words, or of a triple's two pairs."""
    with np.errstate(over="ignore"):
        return mix((first * _ODD + second) * _ODD + np.uint64(order))


def _places(text: np.ndarray, key: np.ndarray, turn: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By order: (last token, text, key) of a turn's pairs and triples of a block; a triple has the turn of its first pair."""
    same = text[1:] == text[:-1]
    pair = gram_keys(key[:-1], key[1:], 2)
    own = same & (_turn(pair) == turn)
    two, three = np.flatnonzero(own) + 1, np.flatnonzero(same[1:] & own[:-1]) + 2
    return {2: (two, text[two], pair[two - 1]), 3: (three, text[three], gram_keys(pair[three - 2], pair[three - 1], 3))}


def _ranges(n_tokens: int) -> int:
    """Ranges of each turn."""
    return max(8, -(-n_tokens // (TURNS * RANGE_TOKENS)))


def _turn(key: np.ndarray) -> np.ndarray:
    """The turn of a pair's key, by other bits than its range."""
    return (key & _LOW) * np.uint64(TURNS) >> _HALF


def _turn_of(key: str) -> Column:
    """:func:`_turn` of a column."""
    return F.shiftright(F.col(key).bitwiseAND(F.lit(int(_LOW))) * TURNS, int(_HALF)).cast("int")


def _cut(key: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, numbers of the ranges that hold keys, bounds): keys in this order lie range by range, else as they came."""
    part = ((key >> _HALF) * np.uint64(ranges) >> _HALF).astype(np.min_scalar_type(ranges))
    order = np.argsort(part, kind="stable")
    held, first = np.unique(part[order], return_index=True)
    return order, held.astype(np.int32), np.append(first, len(order))


def _deal(key: np.ndarray, ranges: int, *columns: np.ndarray) -> list[pa.Array]:
    """One row a range of keys: its number, and per column the bytes of its values."""
    order, held, bounds = _cut(key, ranges)
    packed = [pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((bounds * c.itemsize).astype(np.int32)), pa.py_buffer(c[order].tobytes())]) for c in columns]
    return [pa.array(held), *packed]


def _thin(values: np.ndarray) -> bytes:
    """Differences of neighbours, byte by byte, so that ascending values compress."""
    return np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _thick(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(size, -1).T.copy().view(kind).ravel(), dtype=kind)


def _values(column: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind)


def _summed(key: np.ndarray, payload: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys, ascending, what belongs to them, and sums of their counts."""
    by = np.argsort(key)
    key = key[by]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[heads], [x[by[heads]] for x in payload], [np.add.reduceat(c[by].astype(np.int64), heads) if len(key) else np.zeros(0, np.int64) for c in counts]


_DEALT_GRAMS = T.StructType(
    [T.StructField(c, T.IntegerType()) for c in ("part", "size", "n")] + [T.StructField(c, T.BinaryType()) for c in ("rare", "code", "words", "training", "other")]
)
_MASK = np.uint64((1 << int(_BITS)) - 1)
#: By the marks of rare words: how far back the first of them stands.
_FIRST_RARE = np.array([0, 0, 1, 1, 2, 2, 2, 2])


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _coded(shared):
    """(own, text) rows to one row a block: a number of its first text, ``own`` and tokens of each, and the tokens.

    A frequent word is its number and 1 in three bytes, any other 0 and its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Frequent = shared.value
        codec = _codec()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in blocks(batch.column(1)):
                text, key = tokens(block)
                texts = len(block.bounds) - 1
                place = places_in(frequent.index, key)
                number = np.zeros(len(key), np.int32)
                number[place >= 0] = frequent.number[place[place >= 0]] + 1
                own = pa.ListArray.from_arrays(pa.array([0, texts], pa.int32()), batch.column(0).slice(block.first, texts))
                parts = (np.bincount(text, minlength=texts).astype(np.int32).tobytes(), codec.compress(number.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), asbytes=True), key[place < 0].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([row]), own, *(pa.array([x], pa.binary()) for x in parts)], names=["row", "own", "sizes", "numbers", "rare"])
                row += texts

    return run


def _coded_table(rows: DataFrame, shared, kind: T.DataType) -> DataFrame:
    return _written(rows.mapInArrow(_coded(shared), T.StructType([T.StructField("row", T.LongType()), T.StructField("own", T.ArrayType(kind))] + [T.StructField(c, T.BinaryType()) for c in ("sizes", "numbers", "rare")])), "coded")


def _decoded_blocks(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, own, text, key, number) of every block; a rare word's number is -1."""
    codec = _codec()
    for batch in batches:
        for i in range(len(batch)):
            row, own, sizes, numbers, rare = (c[i] for c in batch.columns)
            sizes = np.frombuffer(sizes.as_py(), np.int32)
            n = int(sizes.sum())
            low, middle, high = np.frombuffer(codec.decompress(numbers.as_py(), n * 3, asbytes=True), np.uint8).reshape(3, -1).astype(np.int32)
            number = (low | middle << 8 | high << 16) - 1
            key = frequent.words[number] if len(frequent.words) else np.zeros(n, np.uint64)
            key[number < 0] = np.frombuffer(rare.as_py(), np.uint64)
            yield row.as_py(), own.values, np.repeat(np.arange(len(sizes)), sizes), key, number


def _grams(shared, ranges: int, turn: int):
    """Counts of a turn's pairs and triples, summed over DEALT places and dealt by ranges of their keys.

    An n-gram is sent as the numbers of its frequent words in one code, marks of its rare words and
    the hashes of these. N-grams without rare words go under a negative size, as ascending codes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Frequent = shared.value
        codec = _codec()
        held: list[tuple[np.ndarray, ...]] = []
        n = texts = 0

        def packed(size: int, by: np.ndarray, key: np.ndarray, at: np.ndarray | None, rare: np.ndarray, code: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
            order, parts, bounds = _cut(by, ranges)
            cells = [order[s:e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            backs = range(abs(size) - 1, -1, -1)
            words_ = [b"" if at is None else _thin(np.concatenate([key[at[c] - back][rare[c] >> back & 1 == 1] for back in backs])) for c in cells]
            columns = [
                [b"" if at is None else rare[c].tobytes() for c in cells],
                [codec.compress(_thin(code[c]), asbytes=True) for c in cells],
                words_,
                *([x[c].astype(np.int32).tobytes() for c in cells] for x in counts),
            ]
            numbers = [pa.array(parts), pa.array(np.full(len(parts), size, np.int32)), pa.array(np.diff(bounds).astype(np.int32))]
            return pa.RecordBatch.from_arrays([*numbers, *(pa.array(x, pa.binary()) for x in columns)], names=_DEALT_GRAMS.names)

        def out() -> Iterator[pa.RecordBatch]:
            text, key, number, other = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for size, (last, _, gram) in _places(text, key, turn).items():
                code, rare = np.zeros(len(last), np.uint64), np.zeros(len(last), np.uint8)
                for back in range(size - 1, -1, -1):
                    of = number[last - back]
                    code = code << _BITS | np.maximum(of, 0).astype(np.uint64)
                    rare = rare << 1 | (of < 0)
                short, gone = rare == 0, other[last]
                own, _, counts = _summed(code[short], [], [~gone[short], gone[short]])
                yield packed(-size, mix(own), key, None, rare, own, counts)
                gram, (at, rare, code), counts = _summed(gram[~short], [last[~short], rare[~short], code[~short]], [~gone[~short], gone[~short]])
                lead = key[at - _FIRST_RARE[rare]]
                order = np.lexsort((lead, rare))
                yield packed(size, gram[order], key, at[order], rare[order], code[order], [c[order] for c in counts])

        for _, kept, text, key, number in _decoded_blocks(batches, frequent):
            held.append((text + texts, key, number, kept.to_numpy(zero_copy_only=False).astype(bool)[text]))
            texts += len(kept)
            n += len(key)
            if n >= DEALT:
                yield from out()
                n = 0
        if n:
            yield from out()

    return run


def _decoded(frequent: Frequent, code: np.ndarray, size: int) -> list[np.ndarray]:
    """The frequent words of codes, first to last; a rare word's place holds any word."""
    if not len(frequent.words):
        return [np.zeros(len(code), np.uint64) for _ in range(size)]
    return [frequent.words[(code >> (_BITS * np.uint64(back)) & _MASK).astype(np.int64)] for back in range(size - 1, -1, -1)]


def _halves(word: list[np.ndarray]) -> list[np.ndarray]:
    """What an n-gram's key is of: two words, or a triple's two pairs."""
    return word if len(word) == 2 else [gram_keys(word[0], word[1], 2), gram_keys(word[1], word[2], 2)]


def _counts(shared, least: int, hot: int):
    """The counts of one range: n-grams that are arcs, or frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Frequent = shared.value
        codec = _codec()
        held: dict[int, list] = {2: [], 3: [], -2: [], -3: []}
        for batch in batches:
            for size, n, rare, code, words_, training, other in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if not n:
                    continue
                payload = [_thick(codec.decompress(code, n * 8, asbytes=True), np.uint64)]
                if size > 0:
                    word, rare, hashes, done = _decoded(frequent, payload[0], size), np.frombuffer(rare, np.uint8), _thick(words_, np.uint64), 0
                    for place, back in enumerate(range(size - 1, -1, -1)):
                        here = np.flatnonzero(rare >> back & 1)
                        word[place][here] = hashes[done : done + len(here)]
                        done += len(here)
                    payload = _halves(word)
                held[size].append((*payload, np.frombuffer(training, np.int32), np.frombuffer(other, np.int32)))
        for size in held:
            if not held[size]:
                continue
            *payload, training, other = (np.concatenate(x) for x in zip(*held[size], strict=True))
            held[size] = []
            key, payload, (c, m) = _summed(gram_keys(*payload, size) if size > 0 else payload[0], payload if size > 0 else [], [training, other])
            kept = (c >= least) | (c + m >= hot)
            key, payload, c, m = key[kept], [x[kept] for x in payload], c[kept], m[kept]
            if size < 0:
                payload = _halves(_decoded(frequent, key, -size))
                key = gram_keys(*payload, -size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), abs(size), np.int32)), *(pa.array(x.view(np.int64)) for x in (key, *payload, c, c + m))], names=["size", "key", "first", "second", "n", "places"])

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """:func:`storage.written`; Spark removes what the writing shuffled when it ends."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return storage.written(df, name)
    finally:
        conf.set(key, before)


class Model(NamedTuple):
    automaton: Automaton
    frequent: Frequent
    words: DataFrame  # word, training, fail
    grams: DataFrame  # key, turn, weight: arcs that aren't scored where they stand
    n_tokens: int  # N
    n_words: int  # V
    ranges: int


def train(docs: DataFrame, held_out: Column, shares: Shares = Shares(), discount: float = 0.5) -> Model:
    """Count all training texts (rows where ``held_out`` is not true) and smooth by absolute discounting.

    The unigram of a word with c training places among N tokens and V distinct ones is
    (c + 1) / (N + V + 1), which leaves one part for all words never seen.
    """
    rows = docs.select(F.coalesce(held_out, F.lit(False)).alias("_held"), "text")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as for a grouping: the number of words isn't known yet
    dealt = rows.mapInArrow(_unigrams(ranges), "part int, word binary, training binary, other binary").repartitionById(ranges, "part")
    unigrams = _written(dealt.mapInArrow(_word_counts, "word long, training long, other long"), "unigrams")
    sums = unigrams.agg(F.sum("training").alias("n"), F.sum("other").alias("m"), F.count(F.when(F.col("training") > 0, 1)).alias("v")).first()
    n, m, v = sums.n or 0, sums.m or 0, sums.v or 0
    ranges = _ranges(n + m)
    often, least, frequent = (max(2, math.ceil(share * of)) for share, of in ((shares.word, n), (shares.arc, n), (shares.gram, n + m)))
    hot = unigrams.filter(F.col("training") + F.col("other") >= max(2, math.ceil(shares.hot * (n + m))))
    often_seen = hot.select("word", (F.col("training") + F.col("other")).alias("n")).toArrow()  # at most 1 / hot_share
    keys, places = often_seen["word"].to_numpy().view(np.uint64), often_seen["n"].to_numpy()
    keys = keys[np.lexsort((keys, -places))][: 1 << int(_BITS)]
    by = np.argsort(keys)
    numbers = Frequent(index(keys[by]), by.astype(np.int32), keys)
    numbered = docs.sparkSession.sparkContext.broadcast(numbers)
    coded = _coded_table(rows, numbered, T.BooleanType())
    counted = [_written(coded.mapInArrow(_grams(numbered, ranges, turn), _DEALT_GRAMS).repartitionById(ranges, "part").mapInArrow(_counts(numbered, least, frequent), "size int, key long, first long, second long, n long, places long"), "grams") for turn in range(TURNS)]
    storage.delete(coded)
    grams = reduce(DataFrame.unionByName, counted)
    keys = np.sort(grams.filter(F.col("places") >= frequent).select("key").toArrow()["key"].to_numpy().view(np.uint64))  # at most 2 / gram_share rows
    arcs = grams.filter(F.col("n") >= least)

    # Each join with words or pairs reads one side by its own key: large histories are split by Spark, not gathered.
    own = unigrams.filter(F.col("training") >= often).select("word", F.col("training").alias("c"))
    p1 = (F.col("c") + 1).cast("double") / F.lit(float(n + v + 1))
    pairs = _written(arcs.filter("size = 2").join(own.select(F.col("word").alias("second"), p1.alias("lower")), "second").select("key", "first", "n", "places", "lower"), "pairs")
    taken = lambda of: of.groupBy("first").agg(F.sum(F.col("n") - discount).alias("taken"))
    rest = lambda c: F.when(F.col("taken").isNull(), 1.0).otherwise(F.greatest(1 - F.col("taken") / c, F.lit(1e-12)))
    words_ = unigrams.join(taken(pairs).withColumnRenamed("first", "word"), "word", "left")
    c = F.col("training")
    words_ = _written(words_.select("word", "training", (c + F.col("other")).alias("places"), F.when(c >= often, rest(c)).alias("rest")), "words")
    states = words_.filter("rest is not null").select(F.col("word").alias("first"), F.col("training").alias("c"), "rest")
    p = (F.col("n") - discount) / F.col("c") + F.col("rest") * F.col("lower")
    gain = F.log10(p) - F.log10("rest") - F.log10("lower")
    counted_pairs, pairs = pairs, _written(pairs.join(states, "first").select("key", "n", "places", p.alias("p"), gain.alias("gain")), "pairs")
    storage.delete(counted_pairs)

    triples = _written(arcs.filter("size = 3").join(pairs.select(F.col("key").alias("second"), F.col("p").alias("lower")), "second").select("key", "first", "n", "places", "lower"), "triples")
    for done in counted:
        storage.delete(done)
    states = pairs.join(taken(triples).withColumnRenamed("first", "key"), "key", "left")
    counted_pairs, pairs = pairs, _written(states.select("key", F.col("n").alias("c"), "places", rest(F.col("n")).alias("rest"), "gain"), "pairs")
    storage.delete(counted_pairs)
    states = pairs.select(F.col("key").alias("first"), "c", "rest")
    weights = pairs.select("key", _turn_of("key").alias("turn"), "places", (F.col("gain") + F.log10("rest")).alias("weight")).unionByName(triples.join(states, "first").select("key", _turn_of("first").alias("turn"), "places", gain.alias("weight")))
    weights = _written(weights, "weights")
    for done in (unigrams, triples, pairs):
        storage.delete(done)

    hot = words_.filter(F.col("places") >= max(2, math.ceil(shares.hot * (n + m)))).toArrow()  # at most 1 / hot_share rows
    place = lookup(numbers.index.keys[:-1], hot["word"].to_numpy().view(np.uint64))
    own = numbers.number[place[place >= 0]]
    count, fail = np.zeros(len(numbers.words)), np.zeros(len(numbers.words))
    count[own], fail[own] = hot["training"].to_numpy()[place >= 0], np.log10(hot["rest"].fill_null(1.0).to_numpy())[place >= 0]
    known = weights.filter(F.col("places") >= frequent).select("key", "weight").toArrow()
    weight = np.zeros(len(keys))
    weight[lookup(keys, known["key"].to_numpy().view(np.uint64))] = known["weight"].to_numpy()
    a = Automaton(np.log10((count + 1) / (n + v + 1)), count > 0, fail, index(keys), weight)
    return Model(a, numbers, words_.select("word", "training", F.log10(F.coalesce("rest", F.lit(1.0))).alias("fail")), weights.filter(F.col("places") < frequent).select("key", "turn", "weight"), n, v, ranges)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` after A-Z went to lower case, and one end; score is the
    automaton's log10 probability of the text, base_score that of the unigrams alone; n_known
    counts tokens seen in training. Null and empty texts have the end token only. Repeated rows
    come out as often as they are; a null doc_id stays null; an empty table gives an empty result;
    with no training text all words share one unseen unigram of probability 1. Other columns are
    not read.
    """
    spark = docs.sparkSession
    shared, numbered = spark.sparkContext.broadcast(model.automaton), spark.sparkContext.broadcast(model.frequent)
    ranges = model.ranges
    kind = docs.schema["doc_id"].dataType
    scores = [T.StructField("row", T.LongType()), T.StructField("automaton", T.DoubleType()), T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("word", T.ArrayType(T.LongType())), T.StructField("n", T.ArrayType(T.IntegerType()))]
    places = [T.StructField("part", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("place", T.BinaryType()), T.StructField("weight", T.BinaryType())]
    schema, sums_schema, width = T.StructType(scores + places), T.StructType(scores + places[2:]), len(scores)

    def rows(turn: int):
        """A row a text, with what its frequent n-grams add, and the other n-grams in a row a range; ``row`` of these is that of place 0.

        Only the first turn's rows of texts have the words.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a: Automaton = shared.value
            n = end = 0
            held: list = []
            kinds: list = []

            def out() -> pa.RecordBatch:
                key, place = (np.concatenate(x) for x in zip(*held, strict=True))
                base = int(place[0])
                part, key, place = _deal(key, ranges, key, (place - base).astype(np.int32))
                place = pa.array([_thin(np.frombuffer(x, np.int32)) for x in place.to_pylist()], pa.binary())
                none = [pa.nulls(len(part), k) for k in kinds]
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(part), base)), *none[1:width], part, key, place, none[-1]], names=schema.names)

            for row, ids, text, key, number in _decoded_blocks(batches, numbered.value):
                texts = len(ids)
                if n >= DEALT or n and row != end:  # places of one row lie close together
                    yield out()
                    held, n = [], 0
                own = np.zeros(texts)
                for _, at, gram in _places(text, key, turn).values():
                    found = places_in(a.grams, gram)
                    here = found >= 0
                    own += np.bincount(at[here], a.weights[found[here]], texts).astype(np.float64)
                    if not here.all():
                        held.append((gram[~here], row + at[~here]))
                        n += len(held[-1][0])
                rows_ = row + np.arange(texts)
                if turn:
                    arrays = [ids, *(pa.nulls(texts, x) for x in (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32())))]
                else:
                    hot = np.flatnonzero(number >= 0)
                    of = number[hot]
                    base = np.bincount(text[hot], a.unigram[of], texts).astype(np.float64)
                    own += base + np.bincount(text[hot], a.fail[of], texts)
                    known = np.bincount(text[hot], a.known[of], texts).astype(np.int64)
                    cold = np.flatnonzero(number < 0)
                    order = cold[np.lexsort((key[cold], text[cold]))]
                    ct, ck = text[order], key[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (ct[1:] != ct[:-1]) | (ck[1:] != ck[:-1])
                    heads = np.flatnonzero(new)
                    bounds = np.searchsorted(ct[heads], np.arange(texts + 1)).astype(np.int32)
                    words_ = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ck[heads].view(np.int64)))
                    times = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.diff(np.append(heads, len(order))).astype(np.int32)))
                    arrays = [ids, pa.array(np.bincount(text, minlength=texts)), pa.array(known), pa.array(base), words_, times]
                arrays = [pa.array(rows_), pa.array(own), *arrays, pa.array((rows_ % ranges).astype(np.int32)), *(pa.nulls(texts, pa.binary()) for _ in range(3))]
                kinds = [x.type for x in arrays]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                end = row + texts
            if n:
                yield out()

        return run

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, weight = (c.to_numpy() for c in batch.columns)
            if len(key):
                part, key, weight = _deal(key.view(np.uint64), ranges, key, weight)
                yield pa.RecordBatch.from_arrays([part, key, weight], names=["part", "key", "weight"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as they are, and what the n-grams of this range add to the texts of each stretch, packed."""
        keys, weights, held, kinds = [], [], [], None
        for batch in batches:
            part = batch.select(["row", "key", "place", "weight"])
            texts = batch.filter(batch["key"].is_null()).select(sums_schema.names)
            kinds = texts.schema
            if len(texts):
                yield texts
            for row, key, place, weight in zip(*(c.to_pylist() for c in part.filter(batch["key"].is_valid()).columns), strict=True):
                if place is None:
                    keys.append(key)
                    weights.append(weight)
                else:
                    held.append((row, key, place))
        if not keys or not held:
            return
        key, weight = _values(keys, np.uint64), _values(weights, np.float64)
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        arcs = index(key)
        for row, gram, place in held:
            found = places_in(arcs, np.frombuffer(gram, np.uint64))
            here = found >= 0
            at, back = np.unique(_thick(place, np.int32)[here], return_inverse=True)
            if len(at):
                columns = {"row": pa.array([row]), "place": pa.array([_thin(at)], pa.binary()), "weight": pa.array([np.bincount(back, weight[found[here]]).tobytes()], pa.binary())}
                yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(1, f.type)) for f in kinds], schema=kinds)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts as they are, and one row for each text that n-grams of any range add to: a stretch is all in one task."""
        held, kinds = [], None
        for batch in batches:
            texts = batch.filter(batch["place"].is_null()).select(schema.names[:width])
            kinds = texts.schema
            if len(texts):
                yield texts
            held.extend(zip(*(c.to_pylist() for c in batch.filter(batch["place"].is_valid()).select(["row", "place", "weight"]).columns), strict=True))
        if not held:
            return
        at, back = np.unique(np.concatenate([row + _thick(place, np.int32).astype(np.int64) for row, place, _ in held]), return_inverse=True)
        sums = np.bincount(back, _values([x for _, _, x in held], np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums), *(pa.nulls(len(at), f.type) for f in list(kinds)[2:])], schema=kinds)

    def met(turn: int) -> DataFrame:
        weights = model.grams.filter(F.col("turn") == turn).select("key", "weight").mapInArrow(packed, "part int, key binary, weight binary")
        both = coded.mapInArrow(rows(turn), schema).unionByName(weights, allowMissingColumns=True)
        sums = both.repartitionById(ranges, "part").mapInArrow(meet, sums_schema).repartition(ranges, "row")
        return _written(sums.mapInArrow(summed, T.StructType(scores)), "scored")

    coded = _coded_table(docs.select("doc_id", "text"), numbered, kind)
    scored = reduce(DataFrame.unionByName, [met(turn) for turn in range(TURNS)])
    storage.delete(coded)
    texts = scored.filter("n_tokens is not null")
    cold = texts.filter(F.size("word") > 0).select("row", F.explode(F.arrays_zip("word", "n")).alias("c")).select("row", F.col("c.word").alias("word"), F.col("c.n").alias("times"))
    c = F.coalesce("training", F.lit(0))
    log = F.log10((c + 1).cast("double") / F.lit(float(model.n_tokens + model.n_words + 1)))
    found = cold.join(model.words, "word", "left")
    added = found.select("row", (log * F.col("times")).alias("cold"), F.when(c > 0, F.col("times")).otherwise(0).alias("cold_known"), (F.coalesce("fail", F.lit(0.0)) * F.col("times")).alias("arcs"))
    grams = scored.filter("n_tokens is null").select("row", F.lit(0.0).alias("cold"), F.lit(0).alias("cold_known"), F.col("automaton").alias("arcs"))
    sums = added.unionByName(grams).groupBy("row").agg(*(F.sum(x).alias(x) for x in ("cold", "cold_known", "arcs")))
    out = texts.select("row", "doc_id", "n_tokens", "n_known", "base", "automaton").join(sums, "row", "left")
    rest = F.coalesce("cold", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("cold_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), (F.col("base") + rest).alias("base_score"), (F.col("automaton") + rest + F.coalesce("arcs", F.lit(0.0))).alias("score"))
