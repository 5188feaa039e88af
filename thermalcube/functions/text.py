"""Text expressions: keys, region names, number formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Prefixes dropped from a region name, in this order, and the one special region.
REGION_PREFIXES = ("DESA", "KELURAHAN", "KABUPATEN")
SPECIAL_REGION = "DAERAH ISTIMEWA YOGYAKARTA"
SPECIAL_REGION_MARKS = ("YOGYAKARTA", "JOGJAKARTA")

_EDGE_SPACE = r"^\s+|\s+$"
# Separates the parts of a natural key, so that ("a", "bc") and ("ab", "c") differ.
_KEY_SEPARATOR = "\u001f"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def upper_trimmed(text: Column) -> Column:
    return F.upper(trimmed(F.coalesce(text, F.lit(""))))


def is_special_region(text: Column) -> Column:
    name = F.upper(F.coalesce(text, F.lit("")))
    return name.contains(SPECIAL_REGION_MARKS[0]) | name.contains(SPECIAL_REGION_MARKS[1])


def normalize_region(text: Column) -> Column:
    """Comparable region name; a prefix counts only at the very start, before trimming."""
    name = F.coalesce(text, F.lit(""))
    for prefix in REGION_PREFIXES:
        name = F.regexp_replace(name, rf"(?i)^{prefix}\s+", "")
    return F.when(is_special_region(text), F.lit(SPECIAL_REGION)).otherwise(F.upper(trimmed(name)))


def joined_key(*parts: Column) -> Column:
    """Parts joined by colons; a missing part stays as an empty one."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def detection_key(latitude, longitude, acq_date, acq_time, satellite, instrument, version) -> Column:
    return joined_key(latitude, longitude, acq_date, acq_time, satellite, instrument, version)


def weather_key(latitude, longitude, datetime) -> Column:
    return joined_key(latitude, longitude, datetime)


def surrogate_id(*parts: Column) -> Column:
    """Repeatable id of a natural key: the same key has the same id in every run and task."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(_KEY_SEPARATOR, *texts), 256)


def format_thousands(number: Column) -> Column:
    """1234567 as 1.234.567."""
    return F.translate(F.format_number(number, 0), ",", ".")


def date_part(text: Column) -> Column:
    """The text before the first T."""
    return F.substring_index(text, "T", 1)


def contains_ignoring_case(text: Column, needle: str) -> Column:
    return F.lower(text).contains(needle.lower())
