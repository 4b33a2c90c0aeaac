"""Which rows, ratios and profiles a corpus accepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratios_valid(parts: list[Column], tolerance: float = 1e-3) -> Column:
    """All there, none negative, and their sum is 1."""
    total, good = F.lit(0.0), F.lit(True)
    for p in parts:
        total, good = total + p, good & (p >= 0)
    return F.coalesce(good & (F.abs(total - 1) <= tolerance), F.lit(False))


def chosen_ratios(sources: dict[str, list[Column]], slack: float = 1e-3) -> Column:
    """struct<source, h, i, s, input_sum, normalised>: the first source, in order, whose three ratios are there, not negative and not all 0.

    Ratios whose sum is not 1 within ``slack`` are divided by it and marked ``normalised``; null
    ratios and "missing" if no source is complete.
    """
    none = F.lit(None).cast("double")
    out = F.struct(F.lit("missing").alias("source"), *[none.alias(c) for c in ("h", "i", "s", "input_sum")], F.lit(False).alias("normalised"))
    for name, parts in reversed(sources.items()):
        total = parts[0] + parts[1] + parts[2]
        off = F.abs(total - 1) > slack
        own = [F.when(off, p / total).otherwise(p).cast("double").alias(c) for c, p in zip("his", parts, strict=True)]
        complete = F.coalesce((parts[0] >= 0) & (parts[1] >= 0) & (parts[2] >= 0) & (total > 0), F.lit(False))
        out = F.when(complete, F.struct(F.lit(name).alias("source"), *own, total.cast("double").alias("input_sum"), off.alias("normalised"))).otherwise(out)
    return out


def comparable_profile(weight: Column, policy: Column, default: str = "log") -> Column:
    """Whether a profile is the corpus's own: the default weight (also if none is given) and transforms of a fixed length."""
    plain = lambda c, other: F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(other))))
    return (plain(weight, default) == default) & (plain(policy, "fixed") == "fixed")


def stable_segment_flags(full: Column, stable: Column, full_centroid: Column, stable_centroid: Column, most_ratio: float = 1.3, most_centroid: float = 2.0) -> dict[str, Column]:
    """How a note's stable part stands for all of it: ratio of densities, of centroids (1 or more), and whether it does not."""
    ratio = F.when(F.abs(stable) > 1e-30, full / stable)
    low = F.least(full_centroid, stable_centroid)
    centroid = F.when(full_centroid.isNotNull() & stable_centroid.isNotNull() & (low > 1e-30), F.greatest(full_centroid, stable_centroid) / low)
    off = F.coalesce(ratio > most_ratio, F.lit(False)) | F.coalesce(centroid > most_centroid, F.lit(False))
    return {"ratio": ratio, "centroid_ratio": centroid, "unrepresentative": off}


def in_family(kind: Column, family: str) -> Column:
    """Component types of a family: its name, or a longer one that starts with it and an underscore."""
    name = F.lower(F.trim(kind))
    return F.coalesce((name == family) | name.startswith(f"{family}_"), F.lit(False))


def low_band_member(label: Column, member: str = "low_band") -> Column:
    """Rows labelled as members; rows from before there were labels pass."""
    return F.coalesce(label == member, F.lit(True))


def short_digest(c: Column, length: int = 12) -> Column:
    return F.substring(F.sha2(c.cast("string"), 256), 1, length)


def seed_from_digest(digest: Column, fallback: int = 0) -> Column:
    """A 31-bit seed from the first eight hex digits of a digest; the fallback without them."""
    head = F.substring(digest, 1, 8)
    return F.when(F.coalesce(head.rlike("^[0-9a-fA-F]{8}$"), F.lit(False)), F.conv(head, 16, 10).cast("long") % (2**31)).otherwise(F.lit(fallback).cast("long"))


def matched_terms(text: Column, terms: dict[str, tuple[str, ...]]) -> Column:
    """The first name, in order, one of whose terms stands in the text as whole words; null if none does."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), F.lit(" "))
    out = F.lit(None).cast("string")
    for name, some in reversed(terms.items()):
        found = F.lit(False)
        for term in some:
            found = found | words.contains(f" {term} ")
        out = F.when(found, name).otherwise(out)
    return out


def first_present(columns: list[str], preference: list[str]) -> str | None:
    """The first preferred column that a table has."""
    return next((c for c in preference if c in columns), None)
