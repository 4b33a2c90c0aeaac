"""Text fit for publication: identities, slugs, profiles, tokens, and paths taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An absolute path of Windows, a file server or a home folder.
LOCAL_PATH = r"(?:(?<![A-Za-z])[A-Za-z]:[\\/](?!/)|\\\\|(?<![\w.])/(?:home|Users|root|mnt|tmp|var)/)[^\s\"']*"
REDACTED = "[path]"
_PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_ASCII = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
DYNAMICS = ("ppp", "pp", "p", "mp", "mf", "f", "ff", "fff")


def ascii_fold(text: Column) -> Column:
    """Without the diacritics of Latin letters."""
    return F.replace(F.translate(text, _PLAIN, _ASCII), F.lit("ß"), F.lit("ss"))


def slug(text: Column, longest: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(ascii_fold(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), 1, longest)


def sample_id(note: Column, stem: Column, row: Column) -> Column:
    """slug of stem or note, and 12 hex digits of SHA-256 of note|stem|row."""
    digest = F.substring(F.sha2(F.concat_ws("|", F.coalesce(note, F.lit("")), F.coalesce(stem, F.lit("")), row.cast("string")), 256), 1, 12)
    return F.concat(slug(F.coalesce(stem, note, F.lit("sample"))), F.lit("__"), digest)


def has_local_path(text: Column) -> Column:
    return F.coalesce(text.rlike(LOCAL_PATH), F.lit(False))


def redact(text: Column) -> Column:
    return F.regexp_replace(text, LOCAL_PATH, REDACTED)


def redact_all(rows: DataFrame) -> DataFrame:
    """Every text column with local paths taken out."""
    return rows.select(*[redact(F.col(n)).alias(n) if k == "string" else F.col(n) for n, k in rows.dtypes])


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens in order of appearance."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(ascii_fold(text)), r"[^a-z0-9]+", " "), " "), lambda t: t != ""))


def dynamic(text: Column) -> Column:
    """The only dynamic mark among a text's tokens, else null."""
    found = F.array_intersect(tokens(text), F.array(*[F.lit(d) for d in DYNAMICS]))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def profile_id(parts: dict[str, Column]) -> Column:
    """k=v|k=v|..., null values left out."""
    return F.concat_ws("|", *[F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in parts.items()])


def parse_profile(profile: Column) -> Column:
    """map<string, string> of a profile."""
    return F.str_to_map(profile, F.lit("\\|"), F.lit("="))


def range_pair(text: Column) -> Column:
    """struct(low, high) of "low-high"."""
    get = lambda i: F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*-\s*(\d+(?:\.\d+)?)", i).try_cast("double")
    return F.struct(get(1).alias("low"), get(2).alias("high"))


def segment_role(path: Column) -> Column:
    return F.when(path.rlike(r"(?i)stable|sustain"), "stable").when(path.rlike(r"(?i)full|whole"), "full").otherwise("unknown")


def public_id(path: Column, note: Column) -> Column:
    return F.concat_ws("_", F.coalesce(note, F.lit("audio")), F.substring(F.sha2(path, 256), 1, 10))


def readable_key(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))
