"""Columns over pitches, keys and transpositions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timegrid import cyclic_phase, div

SHIFTS = range(-5, 7)
#: Names of the twelve tonics.
NAMES = ("C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")
#: Pitch classes of the letters.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def split_pitch(pitch: Column, octave_offset: int = 0) -> Column:
    """Pitch class and register; the sparse note form counts octaves from -1 (``octave_offset=-1``)."""
    return F.struct(F.pmod(pitch, F.lit(12)).alias("pitch_class"), (div(pitch, 12) + octave_offset).alias("register"))


def join_pitch(pitch_class: Column, register: Column) -> Column:
    return register * 12 + pitch_class


def fifths_index(pitch_class: Column) -> Column:
    return F.pmod(7 * pitch_class, F.lit(12))


def chromatic_phase(pitch_class: Column) -> Column:
    return cyclic_phase(pitch_class, 12)


def fifths_phase(pitch_class: Column) -> Column:
    return cyclic_phase(fifths_index(pitch_class), 12)


def rotated(x: Column, y: Column, semitones: Column) -> Column:
    """A point turned by a twelfth of the circle for each semitone."""
    angle = semitones * (2 * math.pi / 12)
    return F.struct((x * F.cos(angle) - y * F.sin(angle)).alias("x"), (x * F.sin(angle) + y * F.cos(angle)).alias("y"))


def shifted(pitch: Column, shift: Column, direction: int = 1) -> Column:
    """Moved by the shift (or back, direction -1); null stays null, leaving 0..127 is an error."""
    new = pitch + direction * shift
    return F.when(new.isNull() | new.between(0, 127), new).otherwise(F.raise_error(F.lit("pitch leaves 0..127")).cast("bigint"))


def major_frame(tonic: Column, mode: Column) -> Column:
    """The relative major's tonic; another mode than major or minor is an error."""
    bad = F.raise_error(F.lit("unknown mode")).cast("bigint")
    return F.when(mode == "major", tonic).when(mode == "minor", F.pmod(tonic + 3, F.lit(12))).otherwise(bad)


def canonical_shift(frame: Column) -> Column:
    """The one shift in -5..6 that brings the frame to 0."""
    up = F.pmod(-frame, F.lit(12))
    return F.when(up <= 6, up).otherwise(up - 12)


def key_label(tonic: Column, mode: Column) -> Column:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (tonic + 1).cast("int"))
    return F.when(mode == "minor", F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, 2, 9))).otherwise(name)


def pitch_class_of(name: Column) -> Column:
    """The pitch class of a letter with sharps and flats; null if it isn't one."""
    letters = F.create_map(*(F.lit(x) for item in LETTERS.items() for x in item))
    base = F.try_element_at(letters, F.upper(F.substring(name, 1, 1)))
    signs = F.substring(name, 2, 9)
    return F.when(signs.rlike("^[#b]*$"), F.pmod(base + F.length(F.regexp_replace(signs, "b", "")) - F.length(F.regexp_replace(signs, "#", "")), F.lit(12)))


def chord_label(label: Column) -> Column:
    """root:quality/bass as root (12 for none) and quality."""
    root, rest = F.substring_index(label, ":", 1), F.regexp_extract(label, ":([^/]*)", 1)
    none = label == "N"
    return F.struct(F.when(none, 12).otherwise(pitch_class_of(F.substring_index(root, "/", 1))).cast("int").alias("root"), F.when(none, "N").otherwise(rest).alias("quality"))


def key_of_label(label: Column) -> Column:
    """root:maj or root:min as tonic and 0 or 1."""
    return F.struct(pitch_class_of(F.substring_index(label, ":", 1)).alias("tonic"), F.when(F.substring_index(label, ":", -1) == "maj", 0).when(F.substring_index(label, ":", -1) == "min", 1).alias("minor"))


def legal_shifts(least: Column, most: Column, shifts: range = SHIFTS) -> Column:
    """Shifts that keep both pitches in 0..127."""
    return F.filter(F.array(*map(F.lit, shifts)), lambda s: (least + s >= 0) & (most + s <= 127))


def drawn_shift(namespace: str, *fields: Column, least: Column, most: Column, shifts: range = SHIFTS) -> Column:
    """A legal shift drawn by the first 64 bits of a digest over the fields, joined by bars."""
    legal = legal_shifts(least, most, shifts)
    digest = F.sha2(F.concat_ws("|", F.lit(namespace), *(f.cast("string") for f in fields)), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return F.element_at(legal, (F.pmod(number, F.size(legal).cast("decimal(20,0)")) + 1).cast("int"))
