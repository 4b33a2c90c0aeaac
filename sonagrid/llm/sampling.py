"""Bounded samples of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def text_hash(text: str = "text") -> Column:
    """What stands for a text where texts would be costly to move."""
    return F.xxhash64(F.lit(5), text)


def distinct_texts(rows: DataFrame, label: str, most: int, by_label: bool, texts: DataFrame | None = None) -> DataFrame:
    """At most ``most`` distinct (text, label) rows, of each label or of all; columns text and ``label``.

    Those with the smallest hashes are taken, so the sample depends on the texts alone, not on how
    the table is dealt, and a text counts once however many copies it has. Only texts whose hash
    lies below a cut are shuffled, copies merged beforehand; the cut lets through a fifth and 100
    more than wanted of the distinct texts (estimated within a few per cent).

    If ``texts`` is given, ``rows`` have the :func:`text_hash` of a text in text_hash instead of the
    text, and the sample's texts are read from its column text at the end.
    """
    key = F.col(label) if by_label else F.lit(0)
    own = (F.first("text").alias("text"),) if texts is None else (F.count(F.lit(1)).alias("_copies"),)
    hashed = rows.select(key.alias("_key"), F.col(label).alias("_label"), *(("text", text_hash().alias("_hash")) if texts is None else (F.col("text_hash").alias("_hash"),)))
    found = hashed.groupBy("_key").agg(F.approx_count_distinct("_hash", 0.02).alias("_n"))
    share = F.least(F.lit(1.0), (1.2 * most + 100) / F.greatest("_n", F.lit(1)))
    cut = found.select("_key", (share * float(1 << 40)).alias("_cut"))  # one row a label
    place = F.pmod("_hash", F.lit(1 << 40))
    some = hashed.join(F.broadcast(cut), "_key").filter(place < F.col("_cut"))
    one = some.groupBy("_key", "_label", "_hash").agg(*own)
    order = Window.partitionBy("_key").orderBy(place, "_hash", "_label")
    picked = one.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= most)
    if texts is not None:
        named = texts.filter(F.col("text").isNotNull()).select("text", text_hash().alias("_hash"))
        picked = named.join(F.broadcast(picked.select("_hash", "_label")), "_hash").groupBy("_hash", "_label").agg(F.first("text").alias("text"))  # ``most`` rows a label
    return picked.select("text", F.col("_label").alias(label))
