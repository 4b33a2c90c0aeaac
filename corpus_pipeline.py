"""Five stages from ``documents`` to packed training sequences.

Every stage works on all that its predecessor kept, and what it decides takes effect: language ID
drops documents without an identifiable language, line dedup takes repeated lines out of the texts,
near-dedup keeps one document of each group, decontamination drops contaminated documents, packing
places the tokens of what is left. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.llm import decontamination, language_id, line_dedup, near_dedup, packing, storage
from sonagrid.llm.columns import carried, restored
from sonagrid.llm.queries import held_out, table, tokenizer_path

#: A document goes if its best language knows less than this share of its n-grams.
LEAST_KNOWN = 0.1

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """A stage whose tasks get texts in batches of bounded bytes, however long its predecessors have run."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose n-grams some language knows; texts and columns stay as they are.

    Null and empty texts have no letter and go; a null doc_id does not matter, but such rows aren't
    learned from; repeated rows are kept or dropped together. An empty table, or one without any
    ``lang``, gives an empty result.
    """
    fitted = language_id.train(docs.filter(~held_out(4)).select("text", "lang"))
    found = language_id.identify(docs.select("text", carried(docs, "text").alias("row")), fitted)
    kept = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("known") >= LEAST_KNOWN)
    return found.filter(kept).select(*restored(docs.columns, "row", "text"))


@bounded
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines found in three documents or more out of all but one of them; a text may end up empty.

    Null texts stay null; rows with a null doc_id count as one document; repeated rows lose the
    same lines. All rows stay.
    """
    return line_dedup.without_repeated_lines(docs)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each class of near duplicates.

    A null text is a class of its own; empty texts, and repeated rows, are one class. A row with a
    null doc_id stays only if its class has no other; of ties one row stays.
    """
    return near_dedup.without_near_duplicates(docs)


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words windows of ``benchmark`` hit five per cent or more.

    Null and empty texts have no words and stay; repeated rows stay or go together.
    """
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents in sequences of at most 2048 tokens, with their ids.

    Null and empty texts have the end token only; repeated rows are packed as often as they are.
    """
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express n-gram filters, sketches or tokenizers.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again.

    What a stage wrote on its way, and its predecessor's table, is deleted once its own is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with storage.scratch() as tables:
            after = storage.written(stage(spark, docs, sf_dir), f"stage-{name}")
            tables.keep(after)
        storage.delete(docs)  # nothing, if it is the corpus itself
        docs = after
    return docs
