"""Time helpers on ``timestamp_ntz`` columns (wall clock = UTC by convention).

Working on NTZ keeps every result independent of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_NTZ = "1970-01-01 00:00:00"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_ntz(col) -> Column:
    """Normalise a timestamp-ish column to ``timestamp_ntz``."""
    return _c(col).cast("timestamp_ntz")


def to_ntz(col, kind: str) -> Column:
    """A time of Spark type ``kind`` as ``timestamp_ntz`` (UTC wall clock):
    timestamps, dates, ISO text, or epoch seconds as a number."""
    c = _c(col)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        us = F.round(c.cast("double") * 1e6).cast("long")
        return F.timestamp_add("MICROSECOND", us, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))
    if kind == "timestamp":
        return instant_to_ntz(c)
    return c.cast("timestamp_ntz")


def date_of(col, grain: str = "day") -> Column:
    """Date of a time, or the first day of its month or year."""
    if grain not in ("day", "month", "year"):
        raise ValueError("grain is day, month or year")
    day = F.to_date(_c(col))
    return day if grain == "day" else F.to_date(F.trunc(day, grain))


def epoch_seconds(col) -> Column:
    """Whole seconds since 1970-01-01 (long)."""
    return F.timestamp_diff("SECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), _c(col))


def seconds_between(start, end) -> Column:
    """end - start in seconds as double (microsecond precision)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)).cast("double") / F.lit(1e6)


def add_seconds(col, seconds) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return F.timestamp_add("SECOND", s, _c(col))


def hour_of(col) -> Column:
    return F.hour(_c(col))


def day_of_week(col) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(col))


def ntz_literal(value) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def ntz_to_instant(col) -> Column:
    """UTC wall clock (``timestamp_ntz``) -> ``timestamp`` instant, independent
    of the session time zone (watermarks need ``timestamp``)."""
    us = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), _c(col))
    return F.timestamp_micros(us)


def instant_to_ntz(col) -> Column:
    """``timestamp`` instant -> UTC wall clock ``timestamp_ntz``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(col)), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))
