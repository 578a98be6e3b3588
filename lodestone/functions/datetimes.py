"""Datetime strings as they are matched in payloads: microseconds since 1970 in UTC, or null."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

#: date, then optionally T, t or a blank, hours and minutes, seconds, a fraction and an offset.
SHAPE = r"^\d{4}-\d{2}-\d{2}([Tt ]([01]\d|2[0-3]):[0-5]\d(:([0-5]\d|60)(\.\d+)?)?([Zz]|[+-]([01]\d|2[0-3])(:?[0-5]\d)?)?)?$"


def let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def micros(text: Column) -> Column:
    """Fractions are cut to microseconds; what is no datetime of this shape gives null.

    A leap second (second 60) counts as the last microseconds of its minute.
    """
    number = lambda t, at, n=2: F.coalesce(F.substring(t, at, n).try_cast("int"), F.lit(0))
    day = F.substring(text, 1, 10).try_cast("date")
    minutes = number(text, 12) * 60 + number(text, 15)
    has_seconds = F.substring(text, 17, 1) == ":"
    second = F.when(has_seconds, number(text, 18)).otherwise(F.lit(0))
    rest = F.when(has_seconds, F.substring(text, 20, 1000)).otherwise(F.substring(text, 17, 1000))

    def behind(r: Column) -> Column:
        """Microseconds of the fraction less those of the offset."""
        fraction = F.regexp_extract(r, r"^\.(\d+)", 1)
        zone = F.regexp_replace(F.regexp_extract(r, r"[+-].*$", 0), ":", "")
        sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
        micro = F.when(second == 60, F.lit(999_999)).otherwise(F.rpad(F.substring(fraction, 1, 6), 6, "0").try_cast("int"))
        return F.coalesce(micro, F.lit(0)) - let(zone, lambda z: sign * (number(z, 2) * 60 + number(z, 4))) * F.lit(60_000_000).cast("long")

    whole = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 1440 + minutes
    at = (whole * 60 + F.least(second, F.lit(59))) * 1_000_000 + let(rest, behind)
    return F.when(F.regexp_like(text, F.lit(SHAPE)) & day.isNotNull(), at)


def parse(text: str) -> int | None:
    """micros() of one string, on the driver."""
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?([Zz]|[+-]\d{2}(?::?\d{2})?)?)?", text)
    if not m or not re.match(SHAPE, text):
        return None
    try:
        day = (date.fromisoformat(m[1]) - date(1970, 1, 1)).days
    except ValueError:
        return None
    second, zone = int(m[4] or 0), (m[6] or "Z").replace(":", "")
    offset = 0 if zone in "Zz" else (-1 if zone[0] == "-" else 1) * (int(zone[1:3]) * 60 + int(zone[3:5] or 0))
    micro = 999_999 if second == 60 else int((m[5] or "")[:6].ljust(6, "0"))
    return ((day * 1440 + int(m[2] or 0) * 60 + int(m[3] or 0) - offset) * 60 + min(second, 59)) * 1_000_000 + micro
