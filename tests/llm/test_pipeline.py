"""The pipeline's stages: columns, effects, and what they keep."""

from __future__ import annotations

import collections

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.storage.written(f(spark, out[-1], SMALL), name))
    return out


def test_columns_and_clean_documents_stay(spark, stages):
    docs, language, lines, near, clean, packed = stages
    assert all(x.columns == docs.columns for x in stages[:-1])
    lettered = docs.filter(F.col("text").rlike(r"\p{L}"))
    assert language.count() >= 0.99 * lettered.count()
    assert lines.count() == language.count() and near.count() <= lines.count() and clean.count() < near.count()
    assert lines.filter("n_chars <> length(text)").count() == 0


def test_decisions_take_effect(spark, stages):
    _, _, lines, near, clean, packed = stages
    seen = collections.Counter()
    for r in lines.select("text").collect():
        seen.update({k.strip(" \t\n\x0b\x0c\r").lower() for k in r.text.split("\n") if len(k) >= 20})
    assert max(seen.values()) < 3
    assert near.select("text").distinct().count() == near.count()
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in clean.select("doc_id").collect()}
    sums = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert sums.filter("n > 2048").count() == 0


def test_stages_take_empty_tables(spark, stages):
    empty = stages[0].filter("false")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SMALL).count() == 0


@pytest.mark.parametrize("name,least", [("language_id", 0), ("line_dedup", 8), ("near_dedup", 5), ("decontamination", 8), ("packing", 8)])
def test_stages_take_nulls_repeats_and_clashing_columns(spark, name, least):
    """Null texts and ids, empty and repeated rows, columns named as the operators' own."""
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, text, "en"), (1, text, "en"), (2, None, None), (None, "an other text of some more words than five", None), (None, None, "en"), (3, "", "en"), (4, "12 34", "fr"), (5, "a text of its own that nobody else has\n" + text, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", "lang", "'s' as source", "cast(length(text) as long) as n_chars")
    docs = docs.withColumns({c: F.lit(7) for c in ("_", "_row", "_rest", "_keep", "_n", "row", "rest", "keep", "sketch", "known", "score", "n_words", "spans", "first", "class")})
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, SMALL)
    assert out.count() >= least
    if name != "packing":
        assert out.columns == docs.columns
        assert out.filter("_keep <> 7 or rest <> 7 or _ <> 7 or known <> 7 or n_words <> 7").count() == 0
    if name == "near_dedup":  # the two rows of document 1 are one class
        assert out.filter("doc_id = 1").count() == 1 and out.filter("text is null").count() == 2


def test_stages_bound_the_bytes_of_batches(spark):
    """However many rows a task reads, it gets them by the megabyte."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    texts = spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text"))
    dict(corpus_pipeline.STAGES)["packing"](spark, texts.withColumn("doc_id", F.lit(1)), SMALL)
    found = [r.n for r in texts.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 8000 * 2000 and max(found) <= 1.1 * corpus_pipeline.storage.BATCH_BYTES
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
