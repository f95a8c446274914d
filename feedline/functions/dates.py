"""Timestamps.  Every result is a UTC wall-clock ``TIMESTAMP_NTZ``.

The session time zone is UTC (see ``session.build_session``), so the
LTZ -> NTZ casts below are the identity on the wall clock.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_to_ts(epoch) -> Column:
    """Integer epoch seconds -> timestamp; 0 or null -> null."""
    e = _col(epoch).cast("bigint")
    return F.timestamp_seconds(F.nullif(e, F.lit(0))).cast("timestamp_ntz")


# RFC 2822 month names, and the zone names that stand for an offset in hours.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}

_DATE = (r"(?i)^(?:[a-z]+\.?,?\s*)?(\d{1,2})[\s-]+([a-z]{3})[a-z]*\.?[\s-]+(\d{2}|\d{4})"
         r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([+-]\d{4}|[a-z]+))?$")


def rfc2822_to_ts(text) -> Column:
    """An RFC 2822 date -> timestamp; unparseable -> null.

    The weekday, the seconds and the zone may be missing, comments in
    parentheses are skipped, two-digit years below 69 are of this century, and
    a zone that is missing or unknown counts as UTC.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"\([^)]*\)", " "), r"\s+", " "))
    part = lambda i: F.nullif(F.regexp_extract(s, _DATE, i), F.lit(""))
    number = lambda i: part(i).try_cast("int")
    year = F.when(F.length(part(3)) == 2, number(3) + F.when(number(3) < 69, 2000).otherwise(1900)).otherwise(number(3))
    month = F.nullif(F.array_position(F.array(*(F.lit(m) for m in MONTHS)), F.lower(part(2))), F.lit(0)).cast("int")
    wall = F.try_make_timestamp_ntz(year, month, number(1), number(4), number(5), F.coalesce(number(6), F.lit(0)).cast("decimal(8,6)"))
    zone = F.lower(part(7))
    named = reduce(lambda c, z: c.when(zone == z[0], F.lit(60 * z[1])), ZONES.items(), F.when(zone.isNull(), F.lit(0)))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.when(zone.rlike(r"^[+-]"), sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int"))).otherwise(named.otherwise(F.lit(0)))
    return wall - F.make_dt_interval(mins=minutes)


def date_to_ts(value) -> Column:
    """A date (or date-like string / timestamp) -> midnight UTC; failure -> null."""
    v = _col(value)
    return v.cast("string").try_cast("date").try_cast("timestamp_ntz")
