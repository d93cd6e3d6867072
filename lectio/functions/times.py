"""Clock and packed times to seconds and back (S-14 to S-19). An unreadable time is -1, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNPARSEABLE = -1.0


def _col(c) -> Column:
    return F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))



def clock_to_seconds(c) -> Column:
    """S-14: h:m:s with an optional fraction; minutes and seconds below 60."""
    pattern = r"^(\d{1,9}):(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
    t = _col(c)
    number = lambda g: F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).try_cast("double")
    good = t.rlike(pattern) & (number(2) < 60) & (number(3) < 60)
    return F.when(good, number(1) * 3600 + number(2) * 60 + number(3)).otherwise(F.lit(UNPARSEABLE))


def minutes_to_seconds(c) -> Column:
    """S-15: m:s with an optional fraction; minutes may exceed 59, seconds not."""
    pattern = r"^(\d{1,9}):(\d{1,2}(?:\.\d+)?)$"
    t = _col(c)
    number = lambda g: F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).try_cast("double")
    return F.when(t.rlike(pattern) & (number(2) < 60), number(1) * 60 + number(2)).otherwise(F.lit(UNPARSEABLE))


def packed_to_seconds(c) -> Column:
    """S-16: HHMMSS with an optional file ending, to whole seconds; null if unreadable."""
    pattern = r"^(\d{2})(\d{2})(\d{2})(?:\.\w+)?$"
    t = _col(c)
    number = lambda g: F.nullif(F.regexp_extract(t, pattern, g), F.lit("")).try_cast("int")
    return F.when(t.rlike(pattern) & (number(2) < 60) & (number(3) < 60), number(1) * 3600 + number(2) * 60 + number(3))


def as_seconds(c) -> Column:
    """S-17: a number or numeric text as it is, else a clock; negative or blank is unreadable."""
    value = F.when(_col(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), _col(c).try_cast("double"))
    number = F.coalesce(value, clock_to_seconds(c))
    return F.when(number >= 0, number).otherwise(F.lit(UNPARSEABLE))


def seconds_to_clock(c) -> Column:
    """S-18: hh:mm:ss, fractions cut off."""
    s = F.floor(F.col(c) if isinstance(c, str) else c).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def seconds_to_packed(c) -> Column:
    """S-18: HHMMSS, fractions cut off."""
    return F.replace(seconds_to_clock(c), F.lit(":"), F.lit(""))


def is_time(c) -> Column:
    """S-19."""
    return (F.col(c) if isinstance(c, str) else c) >= 0
