"""Times as microseconds since 1970, time windows, and ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:[0-5]\d(\.\d+)?Z$"


def to_micros(seconds: Column) -> Column:
    """Half a microsecond is rounded away from zero."""
    return F.round(seconds * 1e6).cast("bigint")


def to_seconds(micros: Column) -> Column:
    return micros.cast("double") / 1e6


def parse_iso(text: Column) -> Column:
    """Microseconds of ``YYYY-MM-DDTHH:MM:SS.fZ``; digits beyond the sixth are cut; anything else is NULL."""
    return F.when(text.rlike(ISO), F.unix_micros(F.try_to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+Z$", "$1Z"))))


def format_iso(micros: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.fZ`` without trailing zeros, ``.0000`` for whole seconds."""
    t = F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", ".0000"), F.lit("Z"))


def window(start: Column, end: Column) -> Column:
    """A closed window; an end before the start counts as the start."""
    return F.struct(start.alias("start"), F.greatest(start, end).alias("end"))


def contains(w: Column, t: Column) -> Column:
    return (w["start"] <= t) & (t <= w["end"])


def overlap(a: Column, b: Column) -> Column:
    """The common part of two windows, NULL where it is empty."""
    lo, hi = F.greatest(a["start"], b["start"]), F.least(a["end"], b["end"])
    return F.when(lo < hi, F.struct(lo.alias("start"), hi.alias("end")))


def merged(a: Column, b: Column) -> Column:
    """The least window that holds both."""
    return F.struct(F.least(a["start"], b["start"]).alias("start"), F.greatest(a["end"], b["end"]).alias("end"))


def extended(w: Column, before: Column, after: Column) -> Column:
    return window(w["start"] - before, w["end"] + after)


def length(w: Column) -> Column:
    return w["end"] - w["start"]
