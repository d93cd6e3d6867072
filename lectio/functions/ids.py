"""Identifiers (S-20 to S-25): lecture, ``lecture#0017``, ``lecture#g007``, ``moment::writer``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def moment_id(lecture, number, gap=False) -> Column:
    """S-20: of a frame event or a gap event; a lecture with a reserved mark or a negative number is refused."""
    made = F.when(F.lit(gap) if isinstance(gap, bool) else gap, F.format_string("%s#g%03d", _col(lecture), _col(number))).otherwise(F.format_string("%s#%04d", _col(lecture), _col(number)))
    bad = _col(lecture).contains("#") | _col(lecture).contains("::") | (_col(lecture) == "") | (_col(number) < 0)
    return F.when(bad, F.raise_error(F.concat(F.lit("no moment id can be made for lecture "), _col(lecture)))).otherwise(made)


def description_id(moment, writer) -> Column:
    """S-21."""
    return F.concat_ws("::", _col(moment), _col(writer))


def moment_of(output_id, moment=None) -> Column:
    """S-22: the part before ``::``, else the moment column, else empty."""
    fallback = F.lit("") if moment is None else F.coalesce(_col(moment), F.lit(""))
    return F.coalesce(F.nullif(F.substring_index(_col(output_id), "::", 1), F.lit("")), fallback)


def writer_of(output_id) -> Column:
    """S-23: the part after the first ``::``; null if absent or empty."""
    c = _col(output_id)
    return F.when(F.instr(c, "::") > 0, F.nullif(F.call_function("substring", c, F.instr(c, "::") + 2), F.lit("")))


def lecture_of(moment) -> Column:
    """S-24: the part before ``#``."""
    return F.substring_index(_col(moment), "#", 1)


def is_gap_moment(moment) -> Column:
    """S-25."""
    c = _col(moment)
    return F.call_function("substring", c, F.instr(c, "#") + 1).startswith("g") & (F.instr(c, "#") > 0)
