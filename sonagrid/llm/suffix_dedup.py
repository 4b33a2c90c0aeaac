"""Repeated byte strings of documents, by suffix buckets sorted one at a time.

A suffix counts by its first ``length`` bytes (its head). Suffixes are dealt to buckets by content:
the least hash of the ``GRAM``-byte strings within the head is equal for equal heads, and the same
for some dozen suffixes in a row, so these travel as one *stretch* of bytes with one key. What
cannot repeat never travels: a first pass finds the keys that stand in two documents.

Within a bucket the suffixes of different stretches of one key are sorted block by block by their
first eight bytes; longer ties are decided by the ranks of a difference-cover sample computed
beforehand. Modulo 7, any two places have a common shift of at most 6 that brings both to places of
{0, 1, 3}, so a tie takes one comparison of ranks (43 bytes from there, for heads of 50) and the
head's last bytes, and never a walk along both texts. A task's memory is one bucket's stretches, their sample
ranks, and one block.

A key with very many occurrences is a bucket too large: its stretches are cut into single heads
and dealt by the head's own hash. Equal stretches within a chunk of documents are sent once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm import storage
from sonagrid.llm.columns import carried
from sonagrid.llm.textarrays import SpanHasher, mix

#: Stands for a null doc_id: one document, smaller than all others.
NO_ID = -(2**63)
LENGTH = 50
#: Bytes whose hashes make a head's key; no shorter string than this is compared by hash alone to find candidates.
GRAM = 20
CHUNK_BYTES = 1 << 23
#: Bytes of one text that are hashed at a time; longer texts go in pieces that overlap by a head.
PIECE_BYTES = 1 << 19
#: Heads in a row that travel together at most (bits of a mask).
STRETCH = 31
#: Occurrences of one key beyond which its heads are dealt one by one.
HOT = 1 << 17
BLOCK = 1 << 18
PERIOD, COVER = 7, (0, 1, 3)


def _shifts() -> np.ndarray:
    """Entry (i, j): the least shift that brings places i and j (modulo PERIOD) to cover places both."""
    return np.array([[next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER) for j in range(PERIOD)] for i in range(PERIOD)])


SHIFT = _shifts()


# --- heads, keys and stretches of one text ---


def least_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` hashes in a row."""
    out, have = hashes, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
    """Byte ranges to hash at a time: whole texts up to PIECE_BYTES, longer ones in overlapping parts."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE_BYTES, "right")) - 1)
        start, end = int(offsets[i]), int(offsets[j])
        while end - start > 2 * PIECE_BYTES:
            yield start, start + PIECE_BYTES + length - 1
            start += PIECE_BYTES
        yield start, end
        i = j


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Per piece: (first head's place, heads in a row, key, text); the runs of heads with equal keys, STRETCH long at most."""
    gram = min(GRAM, length)
    for start, end in pieces(offsets, length):
        n = end - start - length + 1
        if n <= 0:
            continue
        part = data[start:end]
        at = np.arange(len(part) - gram + 1)
        key = least_hashes(SpanHasher(part)(at, at + gram), length - gram + 1)
        first = np.arange(n)
        text = np.searchsorted(offsets, first + start, "right") - 1
        inside = first + start + length <= offsets[text + 1]
        first, key, text = first[inside], key[inside], text[inside]
        if not len(first):
            continue
        new = np.ones(len(first), bool)
        new[1:] = (key[1:] != key[:-1]) | (first[1:] != first[:-1] + 1)
        run = np.flatnonzero(new)
        new |= (np.arange(len(first)) - run[np.cumsum(new) - 1]) % STRETCH == 0
        run = np.flatnonzero(new)
        yield first[run] + start, np.diff(np.append(run, len(first))), mix(key[run]), text[run]


def _texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of binary values, not null."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks != 1 else column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _gathered(data: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after another."""
    total = np.cumsum(width)
    at = np.arange(int(total[-1]) if len(total) else 0)
    return data[at + np.repeat(start - (total - width), width)]


def _longs(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number, in the order of the bytes."""
    out = np.zeros(len(start), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | data[start + k]
    return out


# --- messages: arrays packed into one binary value ---


def packed(*arrays: np.ndarray) -> bytes:
    lengths = np.array([len(arrays), *(len(a) for a in arrays)], np.int64)
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in (lengths, *arrays))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(message: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.decompress(message[8:], int.from_bytes(message[:8], "little"), codec="zstd", asbytes=True)
    lengths = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:]
    at, out = 8 * (len(kinds) + 1), []
    for n, kind in zip(lengths.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _by_bucket(key: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has keys, and the rows of its keys in order."""
    b = bucket_of(key, buckets)
    order = np.argsort(b.astype(np.uint16) if buckets < 65536 else b, kind="stable")
    ends = np.searchsorted(b[order], np.arange(buckets + 1)) if buckets <= len(b) else None
    if ends is None:
        starts = np.flatnonzero(np.append(True, b[order][1:] != b[order][:-1])) if len(b) else np.zeros(0, int)
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(b)).tolist(), strict=True):
            yield int(b[order[s]]), order[s:e]
        return
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _rows(out: list[tuple], names: list[str]) -> pa.Table:
    kinds = {"bucket": pa.int64(), "chunk": pa.int64(), "message": pa.binary()}
    return pa.table({n: pa.array([x[i] for x in out], kinds[n]) for i, n in enumerate(names)})


# --- the passes ---


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers the rows by chunks of about CHUNK_BYTES of text, apart for every task."""
    chunk, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        lengths = batch.column(1).cast(pa.large_binary())
        width = np.diff(np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1])
        ids = np.empty(len(width), np.int64)
        for i, n in enumerate(width.tolist()):
            if size and size + n > CHUNK_BYTES:
                chunk, size = chunk + 1, 0
            size += n
            ids[i] = chunk
        yield pa.RecordBatch.from_arrays([pa.array(ids), *batch.columns], names=["chunk", *batch.schema.names])


def _key_messages(length: int, buckets: int):
    """Distinct keys of each chunk, with how often they stand there and whether in two documents."""

    def of(chunk: int, keys: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        key, doc = (np.concatenate(x) for x in (keys, docs))
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
        ends = np.append(starts[1:], len(key)).astype(int) if len(key) else starts
        key, several, n = key[starts], doc[starts] != doc[ends - 1] if len(key) else np.zeros(0, bool), ends - starts
        times = np.minimum(np.ceil(np.log2(np.maximum(n, 1))), 63).astype(np.uint8) << 1 | several.astype(np.uint8)
        out = [(b, chunk, packed(key[rows], times[rows])) for b, rows in _by_bucket(key, buckets)]
        return _rows(out, ["bucket", "chunk", "message"]).combine_chunks().to_batches()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, keys, docs = None, [], []
        for batch in batches:
            ids, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else []
            for s, e in zip(starts, np.append(starts[1:], len(ids)) if len(ids) else [], strict=True):
                if chunk is not None and chunk != ids[s]:
                    if keys:
                        yield from of(chunk, keys, docs)
                    keys, docs = [], []
                chunk = int(ids[s])
                data, offsets = _texts(batch.column(2).slice(s, e - s))
                for _, _, key, text in stretches(data, offsets, length):
                    keys.append(key)
                    docs.append(doc[s:e][text])
        if keys:
            yield from of(chunk, keys, docs)

    return task


def _repeated(hot: int):
    """The keys of a bucket that stand in two documents, back to the chunks that have them; bit 0: very many occurrences."""

    def bucket(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_numpy()
        parts = [unpacked(m, np.uint64, np.uint8) for m in table.column("message").to_pylist()]
        key, times = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        owner = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        order = np.argsort(key, kind="stable")
        k, t = key[order], times[order]
        starts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        width = np.diff(np.append(starts, len(k)))
        wanted = (width > 1) | (np.maximum.reduceat(t & 1, starts) > 0)
        many = np.add.reduceat(np.exp2((t >> 1).astype(np.float64)), starts) > hot
        rows = np.sort(order[np.repeat(wanted, width)])
        crowded = np.zeros(len(key), np.uint8)
        crowded[order] = np.repeat(many, width)
        bounds = np.searchsorted(owner[rows], np.arange(len(parts) + 1))
        out = [(int(chunks[i]), packed(key[rows[s:e]], crowded[rows[s:e]])) for i, (s, e) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if e > s]
        return _rows(out, ["chunk", "message"])

    return bucket


def _single_heads(first: np.ndarray, heads: np.ndarray, hashes: np.ndarray, many: np.ndarray, text: np.ndarray, data: np.ndarray, length: int):
    """Stretches, those of crowded keys cut into heads under the hashes of their own bytes."""
    if not many.any():
        return first, heads, hashes, text
    n = heads[many]
    at = np.repeat(first[many], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    own = np.concatenate([SpanHasher(data[s : s + PIECE_BYTES + length])(p - s, p - s + length) for s, p in _near(at)])
    return tuple(np.concatenate(x) for x in ((first[~many], at), (heads[~many], np.ones(len(at), heads.dtype)), (hashes[~many], mix(own)), (text[~many], np.repeat(text[many], n))))


def _near(at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Ascending places in groups within PIECE_BYTES."""
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + PIECE_BYTES))
        yield int(at[i]), at[i:j]
        i = j


def _stretch_messages(length: int, buckets: int):
    """A chunk's stretches with repeated keys, by bucket. Of equal ones only those in the chunk's smallest
    document travel; the others' heads all stand in that smaller document, so they are done (bucket of the chunk)."""

    def chunk_of(key: tuple, rows: pa.Table, lists: pa.Table) -> pa.Table:
        if not rows.num_rows or not lists.num_rows:
            return _rows([], ["bucket", "chunk", "message"])
        chunk = int(key[0].as_py())
        parts = [unpacked(m, np.uint64, np.uint8) for m in lists.column("message").to_pylist()]
        known, many = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(known, kind="stable")
        known, many = known[order], many[order].astype(bool)
        data, offsets = _texts(rows.column("text"))
        doc = rows.column("doc").to_numpy()
        found = []
        for first, heads, hashes, text in stretches(data, offsets, length):
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            kept = known[at] == hashes
            found.append((first[kept], heads[kept], hashes[kept], many[at[kept]], text[kept]))
        first, heads, hashes, crowded, text = (np.concatenate(x) for x in zip(*found, strict=True))
        first, heads, hashes, text = _single_heads(first, heads, hashes, crowded, text, data, length)
        width = heads + length - 1
        same, leads = equal_spans(data, first, width, hashes)
        least = np.full(len(leads), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc[text])
        later = doc[text] > least[same]
        place = first - offsets[text]
        out = []
        if later.any():
            full = ((np.int64(1) << heads[later]) - 1).astype(np.uint32)
            out.append((chunk % buckets, chunk, packed(np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint32), text[later].astype(np.uint32), place[later].astype(np.uint64), full)))
        ids = np.flatnonzero(~later)
        ids = ids[np.argsort(same[ids], kind="stable")]
        for b, at in _by_bucket(hashes[leads], buckets):
            number = np.full(len(leads), -1)
            number[at] = np.arange(len(at))
            mine = ids[number[same[ids]] >= 0]
            lead = leads[at]
            out.append((b, chunk, packed(_gathered(data, first[lead], width[lead]), hashes[lead], least[at], heads[lead].astype(np.uint8), number[same[mine]].astype(np.uint32), text[mine].astype(np.uint32), place[mine].astype(np.uint64), np.zeros(0, np.uint32))))
        return _rows(out, ["bucket", "chunk", "message"])

    return chunk_of


def equal_spans(data: np.ndarray, start: np.ndarray, width: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers equal byte spans alike (equal spans have equal keys); and one span of each number. Bytes decide, not hashes."""
    if not len(start):
        return np.zeros(0, int), np.zeros(0, int)
    order = np.lexsort((width, _longs_or_zero(data, start + width - 8), key))
    s, w, k = start[order], width[order], key[order]
    new = np.ones(len(s), bool)
    maybe = np.flatnonzero((k[1:] == k[:-1]) & (w[1:] == w[:-1])) + 1
    for part in np.array_split(maybe, len(maybe) // BLOCK + 1):
        if len(part):
            wide = int(w[part].max())
            steps = np.arange(wide)
            a = data[np.minimum(s[part, None] + steps, len(data) - 1)]
            b = data[np.minimum(s[part - 1, None] + steps, len(data) - 1)]
            new[part] = ((a != b) & (steps < w[part, None])).any(1)
    number = np.empty(len(s), int)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _longs_or_zero(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _longs(data, np.maximum(start, 0))


# --- a bucket: difference-cover sample, then blocks of suffixes ---


def rank_depth(length: int) -> int:
    """Bytes that a sample rank covers: no more than stay within a head from any shift, in steps of the period from eight on."""
    return 8 + (length - PERIOD + 1 - 8) // PERIOD * PERIOD


def sample_ranks(data: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the ``depth`` bytes from every cover place, by doubling in steps of the period; other places have none."""
    place = np.flatnonzero(np.isin(np.arange(len(data)) % PERIOD, COVER))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    rank = np.zeros(len(data) + depth, np.int64)
    rank[place] = np.unique(_longs(padded, place), return_inverse=True)[1] + 1
    have = 8
    while have < depth:
        step = min(have // PERIOD * PERIOD, depth - have)
        rank[place] = np.unique(rank[place] * (len(place) + 2) + rank[place + step], return_inverse=True)[1] + 1
        have += step
    return rank


def equal_heads(data: np.ndarray, place: np.ndarray, key: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A block of suffixes in order of (key, head), and where heads differ from the one before.

    Sorted by key and first eight bytes; ties by a three-way partition around one suffix of each tie,
    all ties at once, each comparison one of sample ranks and of the head's last bytes.
    """
    head = _longs(data, place)
    order = np.lexsort((head, key))
    place, key, head = place[order], key[order], head[order]
    new = np.ones(len(place), bool)
    new[1:] = (key[1:] != key[:-1]) | (head[1:] != head[:-1])
    before, tail = _longs(data, place + length - 16), _longs(data, place + length - 8)
    active = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(active):
        run = np.cumsum(new[active]) - 1
        first = np.flatnonzero(new[active])
        width = np.diff(np.append(first, len(active)))
        pivot = active[first + width // 2][run]
        p, q = place[active], place[pivot]
        d = SHIFT[p % PERIOD, q % PERIOD]
        a, b = rank[p + d], rank[q + d]
        side = np.sign(a - b)
        for x in (before, tail):
            side = np.where(side != 0, side, (x[active] > x[pivot]).astype(np.int64) - (x[active] < x[pivot]))
        moved = np.lexsort((side, run))
        for x in (place, key, before, tail):
            x[active] = x[active[moved]]
        order[active] = order[active[moved]]
        side = side[moved]
        cut = np.zeros(len(active), bool)
        cut[1:] = side[1:] != side[:-1]
        new[active] |= cut
        # A class of equals is decided; the others go on if they are two or more.
        tied = ~(new & np.append(new[1:], True))
        active = active[(side != 0) & tied[active]]
    return order, new


def _sorted_bucket(length: int):
    """Sort a bucket's suffixes block by block; masks of heads that a smaller document has, back to the chunks."""

    def masks(data, start, heads, key, least) -> np.ndarray:
        """Per distinct stretch: bit j is set if head j stands in a document smaller than ``least``, the stretch's own smallest."""
        out = np.zeros(len(start), np.int64)
        order = np.argsort(key, kind="stable")
        new = np.append(True, key[order][1:] != key[order][:-1])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        order, group = order[several], group[several]  # a key with one stretch has nothing to sort
        if not len(order):
            return out
        text = _gathered(data, start[order], heads[order] + length - 1)
        width = heads[order] + length - 1
        begin = np.cumsum(width) - width
        rank = sample_ranks(text, rank_depth(length))
        bounds = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(bounds[1:], len(order))
        suffixes = np.cumsum(heads[order])
        i = 0
        while i < len(bounds):  # one block: the stretches of some keys
            base = suffixes[bounds[i] - 1] if bounds[i] else 0
            j = max(i + 1, int(np.searchsorted(suffixes[ends - 1], base + BLOCK, "right")))
            rows = np.arange(bounds[i], ends[j - 1])
            n = heads[order[rows]]
            owner = np.repeat(rows, n)
            bit = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            place = begin[owner] + bit
            found, head_new = equal_heads(text, place, group[owner], rank, length)
            own = least[order[owner[found]]]
            starts = np.flatnonzero(head_new)
            smallest = np.repeat(np.minimum.reduceat(own, starts), np.diff(np.append(starts, len(own))))
            hit = found[smallest < own]
            np.bitwise_or.at(out, order[owner[hit]], np.int64(1) << bit[hit])
            i = j
        return out

    def bucket(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        parts = [unpacked(m, np.uint8, np.uint64, np.int64, np.uint8, np.uint32, np.uint32, np.uint64, np.uint32) for m in table.column("message").to_pylist()]
        out = [(c, packed(*p[5:8])) for c, p in zip(chunks, parts, strict=True) if not len(p[1])]  # done before
        live = [(c, p) for c, p in zip(chunks, parts, strict=True) if len(p[1])]
        if live:
            data, key, least, heads = (np.concatenate([p[i] for _, p in live]) for i in range(4))
            heads = heads.astype(np.int64)
            width = heads + length - 1
            start = np.cumsum(width) - width
            same, leads = equal_spans(data, start, width, key)
            smallest = np.full(len(leads), np.iinfo(np.int64).max)
            np.minimum.at(smallest, same, least)
            mask = masks(data, start[leads], heads[leads], key[leads], smallest)[same]
            mask = np.where(least > smallest[same], (np.int64(1) << heads) - 1, mask).astype(np.uint32)
            at = 0
            for c, p in live:
                own = mask[at : at + len(p[1])][p[4]]
                at += len(p[1])
                hit = own > 0
                if hit.any():
                    out.append((c, packed(p[5][hit], p[6][hit], own[hit])))
        return _rows(out, ["chunk", "message"])

    return bucket


def _cut(length: int):
    """A chunk's texts without the covered bytes: rest, n_bytes, n_removed, kept, spans."""

    def chunk_of(key: tuple, rows: pa.Table, lists: pa.Table) -> pa.Table:
        data, offsets = _texts(rows.column("text")) if rows.num_rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        begun = np.zeros(len(data), bool)  # where a repeated head begins
        hit_texts = np.zeros(rows.num_rows, bool)
        for m in lists.column("message").to_pylist():
            text, place, mask = unpacked(m, np.uint32, np.uint64, np.uint32)
            hit_texts[text] = True
            at = offsets[text] + place.astype(np.int64)
            for j in range(STRETCH):
                begun[at[(mask >> np.uint32(j)) & np.uint32(1) > 0] + j] = True
        kept, removed, spans = [], [], []
        for i in range(rows.num_rows):
            s, e = int(offsets[i]), int(offsets[i + 1])
            if not hit_texts[i]:
                kept.append(data[s:e].tobytes())
                removed.append(0)
                spans.append([])
                continue
            first = np.flatnonzero(begun[s:e])
            new = np.append(True, first[1:] > first[:-1] + length)
            starts, ends = first[new], first[np.append(new[1:], True)] + length
            gone = np.zeros(e - s + 1, np.int8)
            gone[starts], gone[ends] = 1, -1
            kept.append(data[s:e][np.cumsum(gone[:-1], dtype=np.int8) == 0].tobytes())
            removed.append(int((ends - starts).sum()))
            spans.append(np.stack([starts, ends], 1).ravel().tolist())
        return pa.table({"rest": rows.column("rest"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary()), "spans": pa.array(spans, pa.list_(pa.int64()))})

    return chunk_of


def cut_texts(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Every row's text, as UTF-8 bytes, without what smaller documents have.

    A byte goes if a string of ``length`` bytes (at least 30) that covers it also starts in a document
    with a smaller doc_id; strings are judged on the input, may overlap, and never cross documents.
    Returns ``rest`` (a struct of all columns but text), n_bytes, n_removed, kept (binary: a cut may
    fall within a character) and spans (starts and ends of the removed runs, in turn).

    Null texts are empty; texts shorter than ``length`` stay whole; a null doc_id is smaller than all
    others; rows of one doc_id never remove from each other, repeated rows lose alike. Very long
    texts are hashed in pieces. An empty table gives an empty one; extra columns only pass through.
    """
    if length < 30:
        raise ValueError("strings of at least 30 bytes: what is compared first and last must lie apart")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    given = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), carried(docs, "text").alias("rest"))
    kind = T.StructType([T.StructField("chunk", T.LongType()), *given.schema.fields])
    # Bucketed by chunk, so that the texts meet what is known of their chunk without being shuffled.
    texts = storage.bucketed(given.mapInArrow(_chunked, kind), "chunks", parts, "chunk")
    keys = texts.select("chunk", "doc", "text").mapInArrow(_key_messages(length, buckets), "bucket long, chunk long, message binary")
    lists = keys.groupBy("bucket").applyInArrow(_repeated(hot), "chunk long, message binary")
    sent = texts.select("chunk", "doc", "text").groupBy("chunk").cogroup(lists.groupBy("chunk")).applyInArrow(_stretch_messages(length, buckets), "bucket long, chunk long, message binary")
    masks = storage.written(sent.groupBy("bucket").applyInArrow(_sorted_bucket(length), "chunk long, message binary"), "masks")
    kind = T.StructType([texts.schema["rest"], *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed")), T.StructField("kept", T.BinaryType()), T.StructField("spans", T.ArrayType(T.LongType()))])
    return texts.select("chunk", "text", "rest").groupBy("chunk").cogroup(masks.groupBy("chunk")).applyInArrow(_cut(length), kind)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; see :func:`cut_texts`."""
    cut = cut_texts(docs.select("doc_id", "text"), length)
    return cut.select("rest.doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
