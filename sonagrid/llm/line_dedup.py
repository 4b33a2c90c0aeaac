"""Line deduplication by range-partitioned line hashes.

Lines are keyed by a 128-bit hash. The rows (hash, document, position) are range-partitioned
and sorted by hash, then by document from the largest id down, then by position, and streamed:
the first document of a hash keeps its lines, and once ``min_docs`` different documents have
been seen the others lose theirs. Because the ranges run over document and position too, the
rows of one very common line are dealt over many tasks. What a task cannot know about the run
that its first or last hash began or goes on in another task comes from a first pass, which
returns at most two small rows a task.

The result is a compressed bitmap of kept lines per document; texts are not shuffled by the
operator. :func:`apply_bitmaps` joins the bitmaps to the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm import storage
from sonagrid.llm.columns import carried, restored
from sonagrid.llm.textarrays import blocks, mix, span_hashes

BLANK = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id; such documents count as one, older than all others.
NO_ID = -(2**63)
_LINES = T.StructType([T.StructField(n, t) for n, t in (("h1", T.LongType()), ("h2", T.LongType()), ("doc", T.LongType()), ("body", T.LongType()), ("pos", T.IntegerType()))])


def _line_rows(min_chars: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, body, text = (batch.column(i) for i in range(3))
            doc, body = doc.to_numpy(zero_copy_only=False), body.to_numpy(zero_copy_only=False)
            for block in blocks(text):
                n = len(block.bounds) - 1
                lines = pc.split_pattern(text.slice(block.first, n).fill_null(""), "\n")
                owner = pc.list_parent_indices(lines).to_numpy()
                flat = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=BLANK))
                pos = np.arange(len(owner)) - np.searchsorted(owner, np.arange(n))[owner]
                long = np.flatnonzero(pc.greater_equal(pc.utf8_length(flat), min_chars).to_numpy(zero_copy_only=False))
                keys = flat.take(pa.array(long))
                h = np.concatenate([span_hashes(b.data, b.bounds[:-1], b.bounds[1:]) for b in blocks(keys)] or [np.zeros(0, np.uint64)])
                second = np.concatenate([span_hashes(b.data[::-1], len(b.data) - b.bounds[1:], len(b.data) - b.bounds[:-1]) for b in blocks(keys)] or [np.zeros(0, np.uint64)])
                at = block.first + owner[long]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h.view(np.int64), mix(second + h).view(np.int64), doc[at], body[at], pos[long].astype(np.int32))], names=_LINES.names)

    return rows


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]


def _runs(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Where runs of equal hashes start."""
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    return np.flatnonzero(new)


def _ends(min_docs: int):
    """At most two rows a task: its first and its last hash, each with its largest documents there."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # [(h1, h2), largest documents]
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = _columns(batch)[:3]
            starts = np.append(_runs(h1, h2), len(h1))
            for s, e in sorted({(int(starts[0]), int(starts[1])), (int(starts[-2]), int(starts[-1]))}):
                key, docs = (int(h1[s]), int(h2[s])), np.unique(doc[s:e])[-min_docs:].tolist()
                if last is None or last[0] != key:
                    last = [key, docs]
                    first = first or last
                else:
                    last[1] = sorted({*last[1], *docs})[-min_docs:]
        found = [first] if first is last else [first, last]
        found = [x for x in found if x]  # none for an empty task
        yield pa.RecordBatch.from_arrays([pa.array([x[0][0] for x in found], pa.int64()), pa.array([x[0][1] for x in found], pa.int64()), pa.array([sorted(x[1]) for x in found], pa.list_(pa.int64()))], names=["h1", "h2", "docs"])

    return ends


def _dropped(min_docs: int, known: dict[tuple[int, int], list[int]]):
    """Stream sorted rows; return those whose lines go."""

    def dropped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last hash while fewer than min_docs documents are known
        for batch in batches:
            rows = _columns(batch)
            if not len(rows[0]):
                continue
            if held:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            starts = _runs(rows[0], rows[1])
            # The last run may go on in the next batch: it waits, unless the first pass has decided on it.
            tail = int(starts[-1])
            if (int(rows[0][tail]), int(rows[1][tail])) in known:
                held = []
            else:
                held = [x[tail:] for x in rows]
                if len(np.unique(held[2])) >= min_docs:  # decided: stream the run, keep what decides on its rest
                    known[int(held[0][0]), int(held[1][0])] = np.unique(held[2])[-min_docs:].tolist()
                    held = []
                else:
                    rows, starts = [x[:tail] for x in rows], starts[:-1]
            if len(starts):
                yield _decide(rows, starts)
        if held:
            yield _decide(held, np.zeros(1, np.int64))

    def _decide(rows: list[np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        h1, h2, doc, body, pos = rows
        lengths = np.diff(np.append(starts, len(h1)))
        new_doc = np.ones(len(h1), bool)
        new_doc[1:] = doc[1:] != doc[:-1]
        new_doc[starts] = True
        many = np.add.reduceat(new_doc.astype(np.int64), starts) >= min_docs
        keep = doc[starts]
        for i in {0, len(starts) - 1}:
            if docs := known.get((int(h1[starts[i]]), int(h2[starts[i]]))):
                many[i], keep[i] = len(docs) >= min_docs, max(docs)
        gone = np.repeat(many, lengths) & (doc != np.repeat(keep, lengths))
        return pa.RecordBatch.from_arrays([pa.array(x[gone]) for x in (doc, body, pos)], names=["doc", "body", "pos"])

    return dropped


def dropped_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc, body, pos) of every line that goes; repeated for repeated rows. See :func:`line_bitmaps`."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("body"), F.col("text"))
    lines = storage.written(keyed.mapInArrow(_line_rows(min_chars), _LINES), "lines")
    ranged = lines.repartitionByRange("h1", "h2", F.desc("doc"), "body", "pos").sortWithinPartitions("h1", "h2", F.desc("doc"), "body", "pos")
    ranged = ranged.persist(StorageLevel.DISK_ONLY)
    known: dict[tuple[int, int], set[int]] = {}
    for row in ranged.mapInArrow(_ends(min_docs), "h1 long, h2 long, docs array<long>").collect():  # two rows a task at most
        known.setdefault((row.h1, row.h2), set()).update(row.docs)
    decided = {k: sorted(v)[-min_docs:] for k, v in known.items()}
    out = storage.written(ranged.mapInArrow(_dropped(min_docs, decided), "doc long, body long, pos int"), "dropped-lines")
    ranged.unpersist()
    storage.delete(lines)
    return out


def pack_bits(drop: list[int]) -> bytes:
    """A compressed bitmap: bit i is set if line i stays; lines beyond the last byte stay."""
    at = np.asarray(drop, np.int64)
    bits = np.ones((int(at.max()) // 8 + 1) * 8 if len(at) else 0, np.uint8)
    bits[at] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 6)


def kept_lines(lines: list, bitmap: bytes | None) -> list:
    """The lines that a bitmap keeps; no bitmap keeps all."""
    if bitmap is None:
        return lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return [x for i, x in enumerate(lines) if i >= len(bits) or bits[i]]


def line_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: doc_id, body, n_dropped, keep.

    A line's key is the line without blanks (space, \\t to \\r) at both ends and with A-Z in lower
    case. A key of at least ``min_chars`` code points found in at least ``min_docs`` documents
    loses all its lines except those in the largest doc_id that holds it. ``body`` is
    xxhash64(text): it tells documents that share a doc_id apart (they count as one document).
    Repeated equal rows share one bitmap. Null or empty texts have one empty line and lose
    nothing; a null doc_id counts as one document, smaller than all others. An empty table gives
    an empty result; other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            drops = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in drops], pa.int64()), pa.array([pack_bits(x) for x in drops], pa.binary())], names=["doc_id", "body", "n_dropped", "keep"])

    grouped = dropped_lines(docs, min_chars, min_docs).groupBy("doc", "body").agg(F.collect_set("pos").alias("pos"))
    return grouped.mapInArrow(pack, "doc_id long, body long, n_dropped long, keep binary")


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns in: text, rest, n_dropped, keep. The text loses its dropped lines."""
    for b in batches:
        texts, keep = b.column(0).to_pylist(), b.column(3).to_pylist()
        out = [t if k is None or t is None else "\n".join(kept_lines(t.split("\n"), k)) for t, k in zip(texts, keep, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(out, b.schema.field(0).type), *(b.column(i) for i in range(1, 4))], names=b.schema.names)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, rest: Column) -> DataFrame:
    """text without its dropped lines, ``rest`` (an expression over ``docs``), n_dropped and keep (0 and null without a bitmap)."""
    given = docs.select("text", rest.alias("rest"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("body"))
    marks = bitmaps.select(F.col("doc_id").alias("doc"), "body", "n_dropped", "keep")
    joined = given.join(marks.hint("shuffle_hash"), ["doc", "body"], "left").select("text", "rest", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")
    return joined.mapInArrow(_strip, joined.schema)


def without_repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the lines of :func:`line_bitmaps` taken out of ``text``; all columns stay, in order.

    An ``n_chars`` column is brought up to date for texts that lost lines. Other columns pass
    through, whatever their names; repeated rows lose the same lines; see :func:`line_bitmaps` for
    nulls and empty texts.
    """
    out = apply_bitmaps(docs, line_bitmaps(docs, min_chars, min_docs), carried(docs, "text"))
    columns = restored(docs.columns, "rest", "text")
    if "n_chars" in docs.columns:
        n = F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("rest")["n_chars"])
        columns[docs.columns.index("n_chars")] = n.alias("n_chars")
    return out.select(*columns)


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the lines that stay, and the bitmap."""
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(1)).cast("long")
    out = apply_bitmaps(docs, line_bitmaps(docs, min_chars, min_docs), F.struct("doc_id", n_lines.alias("n_lines")))
    return out.select("rest.doc_id", "rest.n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.col("keep").alias("keep_bitmap"))
