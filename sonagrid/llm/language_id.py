"""Language identification by a bit-sliced Bloom filter of n-grams.

Every slot of the filter holds one bit for each language (slices of 64). Looking an n-gram up
gives, in one read per hash function, the set of all languages whose filter has it. A text's
n-grams are counted per language (popcounts); the share of hits that each language's fill makes
by chance is taken off, and the largest corrected count decides.

Training reads a bounded sample of labelled texts (``sample_docs`` a language); its n-gram counts
are made in Spark and only the slots, at most ``slots`` rows, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm import storage
from sonagrid.llm.columns import carried, restored
from sonagrid.llm.sampling import distinct_texts
from sonagrid.llm.textarrays import Block, blocks, mix, parts, released

UNDETERMINED = "und"
GRAMS = (3, 5)  # bytes
#: Texts are cut into n-grams in blocks of so many bytes: every byte costs about 150 in arrays.
BLOCK_BYTES = 1 << 17
_SPACE = np.uint8(32)
#: Letters stay, bytes of longer characters stay, all else is a space.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


class Filter(NamedTuple):
    languages: list[str]
    slots: np.ndarray  # (slots, slices) uint64
    hashes: int
    chance: np.ndarray  # per language: how often its filter says yes by chance


def gram_keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every n-gram: bytes of one word, with a space at either end allowed."""
    data = _FOLD[block.data]
    n = len(data)
    inside = data != _SPACE
    gaps = np.concatenate([[0], np.cumsum(~inside)])
    texts, keys = [], []
    for size in GRAMS:
        # A space before the first and after the last text, so that words there have their ends too.
        text = np.repeat(np.arange(len(block.bounds) - 1), np.diff(block.bounds))
        count = n - size + 1
        if count <= 0:
            continue
        start = np.arange(count)
        good = (gaps[start + size - 1] - gaps[start + 1] == 0) & (text[start] == text[start + size - 1])
        start = start[good]
        key = np.full(len(start), size, np.uint64)
        for k in range(size):
            key = (key << np.uint64(8)) | data[start + k]
        texts.append(text[start])
        keys.append(key)
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(keys)


def _folded(column: pa.Array) -> Iterator[Block]:
    """Blocks of lower-cased texts, each with a space at both ends."""
    for first, some in parts(column):
        edge = pa.scalar("", column.type)
        padded = pc.binary_join_element_wise(edge, pc.utf8_lower(pc.fill_null(some, "")), edge, pa.scalar(" ", column.type))
        for block in blocks(padded, BLOCK_BYTES):
            yield block._replace(first=block.first + first)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = np.array(batch.column(0).to_pylist(), np.int64)
        for block in _folded(batch.column(1)):
            text, key = gram_keys(block)
            of = lang[block.first + text]
            for code in np.unique(of):
                gram, n = np.unique(key[of == code], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), code)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "gram", "n"])


def places(keys: np.ndarray, slots: int, hashes: int) -> list[np.ndarray]:
    """The slots of each key, one array a hash function."""
    h = mix(keys)
    step = mix(h) | np.uint64(1)
    out = []
    with np.errstate(over="ignore"):
        for i in range(hashes):
            out.append(((h + np.uint64(i) * step) >> np.uint64(17)) & np.uint64(slots - 1))
    return out


def train(labelled: DataFrame, sample_docs: int = 1500, slots: int = 1 << 20, hashes: int = 3, share: float = 0.4) -> Filter:
    """Fit the filter on (text, lang) rows; rows without a text or a lang are left out.

    An n-gram enters a language's filter if it occurs there at least twice and at least ``share``
    times as often as in the language where it is most frequent, each relative to all n-grams.
    The sample holds at most ``sample_docs`` distinct texts a language, see :func:`sampling.distinct_texts`.
    """
    rows = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    found = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(found, key=lambda x: (-found[x], x))
    slices = max(1, -(-len(languages) // 64))
    empty = Filter(languages, np.zeros((slots, slices), np.uint64), hashes, np.zeros(len(languages)))
    if not languages:
        return empty
    spark = labelled.sparkSession
    code = spark.createDataFrame(list(zip(languages, range(len(languages)), strict=True)), "lang string, code long")  # one row a language
    picked = distinct_texts(rows, "lang", sample_docs, True).join(F.broadcast(code), "lang")
    counts = storage.written(picked.select("code", "text").mapInArrow(released(_count_grams), "code long, gram long, n long").groupBy("gram", "code").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("code").agg(F.sum("n").cast("double").alias("total"))
    rated = counts.join(F.broadcast(totals), "code").withColumn("rate", F.col("n") / F.col("total"))
    best = F.max("rate").over(Window.partitionBy("gram"))
    kept = rated.withColumn("best", best).filter((F.col("n") >= 2) & (F.col("rate") >= share * F.col("best"))).select("gram", "code")

    def slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gram, of = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)
            for at in places(gram, slots, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(of // 64), pa.array(np.left_shift(np.int64(1), of % 64))], names=["slot", "slice", "bit"])

    table = kept.mapInArrow(slot_rows, "slot long, slice long, bit long").groupBy("slot", "slice").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most slots x slices rows
    filled = empty.slots
    filled[table["slot"].to_numpy(), table["slice"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    storage.delete(counts)
    fill = np.array([np.mean((filled[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
    return Filter(languages, filled, hashes, fill**hashes)


def corrected_counts(column: pa.Array, f: Filter) -> tuple[np.ndarray, np.ndarray]:
    """Per text its number of n-grams, and per language the hits beyond chance."""
    total, hits = np.zeros(len(column)), np.zeros((len(column), len(f.languages)))
    for block in _folded(column):
        text, key = gram_keys(block)
        texts = len(block.bounds) - 1
        own = slice(block.first, block.first + texts)
        n = np.bincount(text, minlength=texts)
        total[own] = n
        at = places(key, len(f.slots), f.hashes)
        for s in range(f.slots.shape[1]):
            have = f.slots[at[0], s]
            for other in at[1:]:
                have &= f.slots[other, s]
            for i in range(64 * s, min(64 * s + 64, len(f.languages))):
                hits[own, i] = np.bincount(text[((have >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)], minlength=texts)
    return total, np.maximum(0, (hits - total[:, None] * f.chance) / (1 - f.chance))


_NEW = ("lang_pred", "score", "known")


def identify(docs: DataFrame, f: Filter) -> DataFrame:
    """``docs`` with lang_pred, score and known (they replace columns of their names).

    score (0 to 1) is the lead of the best language over the second, as a share of the text's
    n-grams; known is the share that the best language knows. A null text, one without a letter,
    and any text when nothing was learned are ``und`` with score 0. A text with letters that no
    language knows gets the language with most labelled rows, score 0. Ties go to the language
    with more labelled rows, then by name. Only ``text`` decides; other columns pass through,
    repeated rows are all kept, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(f)  # slots x slices x 8 bytes
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            total, hits = corrected_counts(b.column(0), own)
            order = np.sort(np.column_stack([np.zeros((len(hits), 2)), hits]), axis=1)
            best, second = order[:, -1], order[:, -2]
            n = np.maximum(total, 1)
            decided = b.column(1).to_numpy(zero_copy_only=False) & bool(own.languages)
            pred = np.where(decided, np.array([*own.languages, UNDETERMINED], object)[hits.argmax(axis=1) if own.languages else -1], UNDETERMINED)
            score, known = (np.where(decided, np.clip(x / n, 0, 1), 0.0) for x in (best - second, best))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(known), b.column(2)], names=["text", *_NEW, "rest"])

    columns = [c for c in docs.columns if c not in _NEW]
    given = docs.select("text", letter.alias("letter"), carried(docs.drop(*_NEW), "text").alias("rest"))
    schema = T.StructType([given.schema["text"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known", T.DoubleType()), given.schema["rest"]])
    return given.mapInArrow(released(rows), schema).select(*restored(columns, "rest", "text"), *_NEW)
