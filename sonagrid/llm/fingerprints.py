"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A shingle is five consecutive words (lower-cased, cut at white space); a text of fewer words, but
not none, is one shingle. The sketch retains every shingle hash below one fixed fraction of the hash
range (``1 / SCALE``), the same for every text, so sketches of parts merge by union and containment
can be estimated between texts of very unequal size. Texts of few shingles may retain none; a
sketch therefore carries a digest of all shingles too, which tells equal texts from others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHINGLE = 5
#: One shingle hash in so many is retained.
SCALE = 4
#: Hashes are cut to 48 bits: 12 hex digits each.
_BITS = 48
_CUT = (1 << _BITS) // SCALE
#: Ranges of more rows than this are looked up by a shuffle, not a broadcast.
_BROADCAST_RANGES = 500_000
#: Tasks for the ranges; beyond as many ranges a task does several, one after the other.
_TASKS = 50_000


def shingle_hashes(text: Column) -> Column:
    """array<long>: a 48-bit hash of every shingle, in text order; empty without words."""
    # An array column that lambdas read is bound once, by transform over a one-element array.
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - SHINGLE + 1, F.lit(1))), lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(SHINGLE)]), 64 - _BITS))))
    return hashed[0]


def sketch(text: Column) -> Column:
    """struct<whole: long, hashes: array<long>>: a digest of all shingles in order, and the retained hashes, distinct and ascending."""
    of = lambda h: F.struct(F.xxhash64(h).alias("whole"), F.array_sort(F.array_distinct(F.filter(h, lambda x: x < _CUT))).alias("hashes"))
    return F.transform(F.array(shingle_hashes(text)), of)[0]


def fingerprint(of: Column) -> Column:
    """A sketch as text: 16 hex digits of the digest, a colon, and 12 for each hash."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat(digits(of["whole"], 16), F.lit(":"), F.array_join(F.transform(of["hashes"], lambda h: digits(h, 12)), ""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two sketches' texts: 1 if they have the same shingles in order, 0 if neither retains any."""
    both = F.size(F.array_intersect(a["hashes"], b["hashes"])).cast("double")
    either = F.size(a["hashes"]) + F.size(b["hashes"]) - both
    return F.when(a["whole"] == b["whole"], 1.0).otherwise(F.coalesce(F.try_divide(both, either), F.lit(0.0)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds; 0 if a retains none (1 if both have the same shingles in order)."""
    both = F.size(F.array_intersect(a["hashes"], b["hashes"])).cast("double")
    return F.when(a["whole"] == b["whole"], 1.0).otherwise(F.coalesce(F.try_divide(both, F.size(a["hashes"])), F.lit(0.0)))


def merged(hashes: Column) -> Column:
    """Aggregate: the retained hashes of several parts' union, from their retained hashes."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(hashes))))


def _ranged(docs: DataFrame, rows_per_range: int | None) -> tuple[DataFrame, DataFrame, int]:
    """(rows with ``range``, one row a range: range, top, number of ranges).

    Rows follow one another from the highest range down: ranges of doc_id from 0 up, and below
    them ranges of the text's hash for rows without a doc_id. Their number grows with the rows.
    """
    ids = docs.select("doc_id")
    n, null = ids.agg(F.count("doc_id"), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    rows_per_range = rows_per_range or max(1000, math.isqrt(n + null))
    k = max(1, -(-n // rows_per_range))
    lows = []
    if k > 1:  # Spark samples the ids and cuts them; one number a range comes to the driver
        dealt = ids.filter("doc_id is not null").repartitionByRange(k, "doc_id").withColumn("part", F.spark_partition_id())
        lows = sorted(r.low for r in dealt.groupBy("part").agg(F.min("doc_id").alias("low")).collect())[1:]
    # How many cuts are at or below the id: a binary search.
    cuts = F.split(F.lit(",".join(map(str, lows))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << x) for x in reversed(range(len(lows).bit_length()))))
    ahead = lambda at, step: (at + step <= len(lows)) & (F.get(cuts, at + step - 1) <= F.col("doc_id"))
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at)) if lows else F.lit(0)
    by_text = -1 - F.pmod(F.xxhash64("text"), F.lit(max(1, -(-null // rows_per_range)))).cast("int")
    rows = docs.withColumn("range", F.when(F.col("doc_id").isNull(), by_text).otherwise(place))
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("top"))
    found = sorted((tuple(r) for r in tops.collect()), reverse=True)
    table = [(r, top, found[i - 1][0]) for i, (r, top) in enumerate(found)]
    return rows, docs.sparkSession.createDataFrame(table, "range int, top long, before int"), len(found)


def with_next(docs: DataFrame, rows_per_range: int | None = None) -> DataFrame:
    """(doc_id, text, sketch) of every row, and next_text, next_sketch.

    Rows follow one another in descending doc_id; ties are ordered by the text's hash and then the
    text, so repeated rows follow one another; rows without a doc_id come last, dealt by their
    text's hash. After the last row comes the first. The ids are cut into ranges of about
    ``rows_per_range`` rows (by default the square root of all, 1000 at least, so both their number
    and their size grow slowly); texts are shuffled once, to their range, and
    sketched there; a window runs within each range, and each range's first row is added, as a
    guest, to the end of the range before it. Only one row a range comes to the driver.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged, ranges, n = _ranged(given, rows_per_range)
    if n <= _BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    heads = ranged.join(ranges, "range").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.groupBy("before").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("head"))
    guests = heads.select(F.lit(None).cast("long").alias("doc_id"), F.col("head.text").alias("text"), F.col("before").alias("range"), F.lit(True).alias("guest"))
    rows = ranged.withColumn("guest", F.lit(False)).unionByName(guests)
    rows = rows.repartition(max(1, min(n, _TASKS)), "range").withColumn("sketch", sketch(F.col("text")))
    rows = rows.withColumn("h", F.xxhash64("text"))
    following = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), "h", "text")
    rows = rows.withColumns({f"next_{c}": F.lead(c).over(following) for c in ("text", "sketch")})
    return rows.filter(~F.col("guest")).drop("guest", "range", "h")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next document's, see :func:`with_next`. near_edited and near_next are estimated
    Jaccard similarities of the text's sketch to the edited text's and to the next document's;
    holds_next is the estimated share of the next document's shingles in this one. Null texts are
    empty; texts without words have the same sketch, so they are alike (1) to each other only. An
    empty table gives an empty result; other columns are not read.
    """
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    own, edited, following = (F.col(c) for c in ("sketch", "edited_sketch", "next_sketch"))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(own).alias("fingerprint"),
        fingerprint(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"),
        likeness(own, following).alias("near_next"),
        containment(following, own).alias("holds_next"),
    )
