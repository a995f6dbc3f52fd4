"""Boxes, rounding, text and list helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_overlap(x1, y1, w1, h1, x2, y2, w2, h2) -> Column:
    """Shared area in percent of the first box; 0 for an empty first box."""
    wide = F.greatest(F.lit(0), F.least(x1 + w1, x2 + w2) - F.greatest(x1, x2))
    high = F.greatest(F.lit(0), F.least(y1 + h1, y2 + h2) - F.greatest(y1, y2))
    return F.when(w1 * h1 > 0, wide * high * 100.0 / (w1 * h1)).otherwise(0.0)


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def time_text(frame: Column) -> Column:
    """m:ss of a frame inside its video."""
    return F.format_string("%d:%02d", floor_div(frame, 3600), F.pmod(floor_div(frame, 60), F.lit(60)))


def video_frame(frame: Column, frames_per_video: int = 63_600) -> Column:
    return F.struct(floor_div(frame, frames_per_video).alias("video"), F.pmod(frame, F.lit(frames_per_video)).alias("frame"))


def frame_second(frame: Column) -> Column:
    """Seconds, halves upwards."""
    return F.floor(frame / 60 + 0.5).cast("long")


def letters(text: Column) -> Column:
    """Latin and Cyrillic letters only, in lower case."""
    return F.lower(F.regexp_replace(text, "[^a-zA-Zа-яА-ЯёЁ]", ""))


def ints_in(text: Column) -> Column:
    """Integers in a text, in order; 1.5 gives two. One beyond 64 bits keeps its place as null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\d+"), F.lit(0)), lambda x: x.try_cast("long"))


def floats_in(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda x: x.cast("double"))


def list_text(values: Column) -> Column:
    """[a, b] as stored in features."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))


def bool_text(value: Column) -> Column:
    return F.initcap(value.cast("string"))


def is_true(text: Column) -> Column:
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def says_true(text: Column) -> Column:
    """Does a stored list of flags hold True?"""
    return F.coalesce(F.contains(text, F.lit("True")), F.lit(False))


def image_id(text: Column) -> Column:
    """Type and text of an icon id, split at the first hyphen."""
    parts = F.split(text, "-", 2)
    return F.struct(parts[0].alias("type"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))


def short_name(name: Column) -> Column:
    return F.when(F.length(name) > 32, F.concat(F.substring(name, 1, 30), F.lit("…"))).otherwise(name)


def spaced(number: Column) -> Column:
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit(" "))


def length_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def top_class(probabilities: Column) -> Column:
    """0-based place of the largest probability, the first of equals; null if there is none."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")


def adaptive_step(speed: Column) -> Column:
    """Frames between samples at a speed; null or zero speed gives null, so the step stays."""
    return F.when(F.coalesce(speed, F.lit(0.0)) != 0, F.greatest(F.lit(2), F.bround(-0.5 * speed + 10.9).cast("int")))
