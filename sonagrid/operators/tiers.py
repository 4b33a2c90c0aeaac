"""A row's partner by ranked tiers of keys: the first tier that names exactly one.

Both sides are unfolded into (tier, key) rows and meet once, whatever the number of tiers. The
targets are aggregated by key beforehand, so a key that many targets share brings one row to the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCHED, AMBIGUOUS, UNMATCHED = "matched", "ambiguous", "unmatched"


def _unfolded(df: DataFrame, id_: str, keys: list[Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("tier"), k.cast("string").alias("key")) for i, k in enumerate(keys)])
    return df.select(F.col(id_).alias("_id"), F.explode(F.filter(cells, lambda c: c["key"].isNotNull() & (F.trim(c["key"]) != ""))).alias("c")).select("_id", "c.*")


def resolve(rows: DataFrame, targets: DataFrame, id_: str, target: str, tiers: list[tuple[str, Column, Column]]) -> DataFrame:
    """(id, target, tier, status, candidates) for every row of ``rows``; ``id_`` must be unique there, ``target`` in ``targets``.

    ``tiers`` are (name, key over rows, key over targets), best first; null and blank keys match
    nothing. ``matched``: the first tier whose key names exactly one target. ``ambiguous``: no tier
    does, but one names several; then the first such tier's smallest target is given, and how many
    there are. ``unmatched``: no target.
    """
    left = _unfolded(rows, id_, [a for _, a, _ in tiers])
    right = _unfolded(targets, target, [b for _, _, b in tiers]).groupBy("tier", "key").agg(F.min("_id").alias("_target"), F.count("*").alias("_n"))
    met = left.join(right, ["tier", "key"])
    first = F.min(F.struct((F.col("_n") > 1).alias("several"), "tier", F.col("_target").alias("target"), F.col("_n").alias("n"))).alias("best")
    found = met.groupBy("_id").agg(first)
    names = F.array(*[F.lit(n) for n, _, _ in tiers])
    joined = rows.select(F.col(id_).alias("_id")).join(found, "_id", "left")
    status = F.when(F.col("best").isNull(), UNMATCHED).when(F.col("best.several"), AMBIGUOUS).otherwise(MATCHED)
    return joined.select(F.col("_id").alias(id_), F.col("best.target").alias(target), F.get(names, F.col("best.tier")).alias("tier"), status.alias("status"), F.coalesce("best.n", F.lit(0)).cast("long").alias("candidates"))


def filled(rows: DataFrame, hints: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with blank values of ``column`` filled from ``hints`` by key, of several hints the last in order of the value.

    Null, blank and the word nan count as blank on both sides; a column that ``rows`` lacks is added.
    """
    blank = lambda c: c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")
    have = rows if column in rows.columns else rows.withColumn(column, F.lit(None).cast("string"))
    known = hints.filter(~blank(F.col(key).cast("string")) & ~blank(F.col(column).cast("string"))).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(column).cast("string")).alias("_hint"))
    met = have.join(known, have[key] == known["_key"], "left")
    own = F.col(column).cast("string")
    return met.select(*[(F.when(blank(own), F.col("_hint")).otherwise(own).alias(c) if c == column else F.col(c)) for c in have.columns])
