"""Note names, pitches and registers from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semitones above C of the seven letters.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
_TOKEN = r"(?i)(?:^|[^A-Za-z])([A-G])([#b♯♭s]?)(-?[0-9])(?:[^0-9]|$)"
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def accidental(c: Column) -> Column:
    """# for sharps (also s and the music sign), b for flats, empty otherwise."""
    return F.when(F.lower(c).isin("#", "♯", "s"), "#").when(F.lower(c).isin("b", "♭"), "b").otherwise("")


def note_token(text: Column) -> Column:
    """The first note of a text, like C#4; null if there is none."""
    letter, sign, octave = (F.regexp_extract(text, _TOKEN, i) for i in (1, 2, 3))
    return F.when(letter != "", F.concat(F.upper(letter), accidental(sign), octave))


def pitch_class(token: Column) -> Column:
    """0 to 11 of a token of :func:`note_token`; Cb and B# wrap around."""
    table = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    step = F.when(F.substring(token, 2, 1) == "#", 1).when(F.substring(token, 2, 1) == "b", -1).otherwise(0)
    return F.pmod(F.try_element_at(table, F.substring(token, 1, 1)) + step, F.lit(12))


def octave(token: Column) -> Column:
    return F.regexp_extract(token, r"(-?[0-9])$", 1).try_cast("int")


def midi(token: Column) -> Column:
    """12 (octave + 1) + letter + accidental: Cb4 is B3."""
    table = F.create_map(*[F.lit(x) for pair in LETTERS.items() for x in pair])
    step = F.when(F.substring(token, 2, 1) == "#", 1).when(F.substring(token, 2, 1) == "b", -1).otherwise(0)
    return 12 * (octave(token) + 1) + F.try_element_at(table, F.substring(token, 1, 1)) + step


def midi_name(number: Column) -> Column:
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.concat(F.get(names, F.pmod(number, F.lit(12)).cast("int")), (F.floor(number / 12) - 1).cast("string"))


def midi_frequency(number: Column, a4: float = 440.0) -> Column:
    return a4 * F.pow(F.lit(2.0), (number - 69) / 12)


def frequency_midi(f: Column, a4: float = 440.0) -> Column:
    return 69 + 12 * F.log2(f / a4)


def register(number: Column) -> Column:
    return F.when(number < 48, "low").when(number < 60, "mid_low").when(number < 72, "mid").when(number < 84, "mid_high").when(number.isNotNull(), "high")


def canonical_note(manifest: Column, file_name: Column, folder: Column) -> Column:
    """struct(note, source): from the manifest, the file name or the folder, in this order."""
    found = [F.when(note_token(c).isNotNull(), F.struct(note_token(c).alias("note"), F.lit(s).alias("source"))) for c, s in ((manifest, "manifest"), (file_name, "filename"), (folder, "folder"))]
    return F.coalesce(*found, F.struct(F.lit(None).cast("string").alias("note"), F.lit("none").alias("source")))
