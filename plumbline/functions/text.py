"""Text, identifier and time helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(c: Column) -> Column:
    """Lower case, dashes and underscores as spaces, runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[-_]", " "), r"\s+", " "))


def safe_segment(c: Column) -> Column:
    """Whether a text can be one segment of a key."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$") & (c != "..") & (c != "."), F.lit(False))


def colour(c: Column) -> Column:
    """`#rrggbb` or `#rrggbbaa` in lower case, or null."""
    return F.when(c.rlike(r"^#[0-9A-Fa-f]{6}([0-9A-Fa-f]{2})?$"), F.lower(c))


def epsg(c: Column) -> Column:
    """`EPSG:<number>` of any spelling of it, or null."""
    n = F.regexp_extract(F.upper(F.trim(c)), r"^(?:EPSG:)?\s*(\d{4,6})$", 1)
    return F.when(n != "", F.concat(F.lit("EPSG:"), n))


def sequence_number(name: Column) -> Column:
    """The last run of digits before a file name's suffix."""
    return F.regexp_extract(name, r"(\d+)(?=\D*\.[^.]+$)", 1).try_cast("long")


def exif_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyy:MM:dd HH:mm:ss"))


def gps_time(week: Column, seconds: Column, leap: int = 18) -> Column:
    """UTC of a GPS week and second."""
    micros = (F.lit(315_964_800) + week.cast("long") * 604_800 + seconds - leap).cast("double") * 1_000_000
    return F.timestamp_micros(micros.cast("long"))


def age_seconds(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0.0), now.cast("double") - then.cast("double"))


def retry_delay(attempt: Column, base: float, most: float) -> Column:
    """base 2^(attempt - 1), at most `most`."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def tags(c: Column, most: int = 30, length: int = 64) -> Column:
    """Trimmed, distinct, in order, cut to a length and a number; empty ones go."""
    trimmed = F.array_distinct(F.filter(F.transform(c, lambda t: F.trim(t)), lambda t: t != ""))
    return F.slice(F.transform(trimmed, lambda t: F.substring(t, 1, length)), 1, most)


def content_key(content: Column, owner: Column) -> Column:
    """Where content of that SHA-256 belongs in an owner's store."""
    digest = F.sha2(content, 256)
    return F.concat_ws("/", owner, F.lit("blobs/sha256"), F.substring(digest, 1, 2), digest)
