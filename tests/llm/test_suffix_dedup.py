"""Repeated strings against brute force: nulls, ties, repeated rows, crowded keys, texts longer than a piece."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonagrid.llm import queries, suffix_dedup
from tests.compare import assert_same, connection
from tests.conftest import SMALL

DOCS = "doc_id long, text string"


def test_sql(spark):
    assert_same(queries.op12_suffix_dedup(spark, SMALL), connection(SMALL), queries.OP12_SQL)


def brute(rows: list[tuple], length: int) -> list[tuple]:
    data = [(suffix_dedup.NO_ID if d is None else d, (t or "").encode()) for d, t in rows]
    least: dict[bytes, int] = {}
    for d, t in data:
        for i in range(len(t) - length + 1):
            head = t[i : i + length]
            least[head] = min(d, least.get(head, d))
    out = []
    for (doc_id, _), (d, t) in zip(rows, data, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = bytes(b for b, g in zip(t, gone[:-1], strict=True) if not g)
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def documents(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["alpha", "be", "gamma ", "dé", "ε", "zeta\n", "x" * 30]
    common = "".join(r.choices(words, k=40))
    rows = []
    for d in range(60):
        own = "".join(r.choices(words, k=r.choice([0, 5, 40, 120])))
        cut = r.randrange(len(common))
        rows.append((d, own[: len(own) // 2] + common[cut : cut + r.randrange(120)] + own[len(own) // 2 :]))
    rows += [(70, common), (71, common), (71, common), (71, common[5:]), (None, common[3:90]), (72, None), (73, ""), (74, "a" * 4000), (75, "a" * 300 + "b"), (76, "ab" * 2000), (77, "ba" * 90)]
    return rows


@pytest.mark.parametrize(("length", "hot"), [(50, suffix_dedup.HOT), (50, 3), (50, 0), (64, 3), (30, suffix_dedup.HOT)])
def test_cut_is_exact(spark, length, hot):
    """Also where crowded keys (more than ``hot`` occurrences) are dealt by single heads."""
    rows = documents(length + hot % 7)
    docs = spark.createDataFrame(rows, DOCS).repartition(5).withColumns({c: F.lit(1) for c in ("chunk", "doc", "rest", "message", "bucket", "kept", "n_bytes")})
    cut = suffix_dedup.cut_texts(docs, length, hot)
    got = cut.select("rest.doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long"), F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, length)
    assert suffix_dedup.cut_texts(docs.filter("false"), length, hot).count() == 0


def test_spans_tell_what_went(spark):
    rows = documents(3)
    for x in suffix_dedup.cut_texts(spark.createDataFrame(rows, DOCS).withColumn("whole", F.col("text"))).collect():
        text, kept = (x.rest.whole or "").encode(), b""
        edges = [0, *x.spans, len(text)]
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            kept += text[s:e]
        assert kept == bytes(x.kept) and sum(x.spans[1::2]) - sum(x.spans[::2]) == x.n_removed


def test_texts_longer_than_a_piece(spark):
    r = random.Random(8)
    long = "".join(r.choices("abcdefgh ", k=3 * suffix_dedup.PIECE_BYTES))
    at = 2 * suffix_dedup.PIECE_BYTES - 70
    rows = [(1, long), (2, "z" * 9 + long[at : at + 140]), (3, long[100:])]
    got = sorted(tuple(x) for x in suffix_dedup.repeat_report(spark.createDataFrame(rows, DOCS)).collect())
    assert [x[:4] for x in got] == [(1, len(long), 0, 0), (2, 149, 140, 1), (3, len(long) - 100, len(long) - 100, 1)]


def test_heads_in_order_by_sample_ranks():
    """Suffixes of one bucket, sorted by ranks and ends, are in the order of their bytes."""
    r = np.random.default_rng(1)
    for length in (30, 43, 50, 64, 99):
        data = np.tile(r.integers(97, 99, 40), 20).astype(np.uint8)
        data[r.integers(0, len(data), 30)] = 120
        place = np.arange(len(data) - length + 1)
        rank = suffix_dedup.sample_ranks(data, suffix_dedup.rank_depth(length))
        order, new = suffix_dedup.equal_heads(data, place, np.zeros(len(place), np.int64), rank, length)
        heads = [data[i : i + length].tobytes() for i in place[order]]
        assert heads == sorted(heads)
        assert new.tolist() == [True, *(a != b for a, b in zip(heads, heads[1:], strict=False))]


def test_cover_meets_every_pair():
    for i in range(suffix_dedup.PERIOD):
        for j in range(suffix_dedup.PERIOD):
            d = suffix_dedup.SHIFT[i, j]
            assert d < suffix_dedup.PERIOD and (i + d) % suffix_dedup.PERIOD in suffix_dedup.COVER and (j + d) % suffix_dedup.PERIOD in suffix_dedup.COVER
