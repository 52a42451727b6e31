"""Times as column expressions. Naive times are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
J2000_POSIX = 946_728_000.0
CTIME_OFFSET = -1_072_958_367.816
LEAP_SECONDS = (
    189302400.0, 205027200.0, 220924800.0, 252460800.0, 283996800.0, 315532800.0, 347155200.0, 378691200.0,
    410227200.0, 441763200.0, 489024000.0, 520560000.0, 552096000.0, 615254400.0, 694224000.0, 757382400.0,
    788918400.0, 836179200.0, 867715200.0, 899251200.0, 946684800.0, 993945600.0, 1041379200.0,
)


def to_unix(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def from_unix(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1e6).cast("long"))


def j2000(unix_seconds: Column) -> Column:
    return unix_seconds - J2000_POSIX


def epoch_to_j2000(t: Column, epoch: Column, leaps: tuple[float, ...] = LEAP_SECONDS) -> Column:
    """Seconds since J2000 from a time in a named epoch; an unknown epoch gives null."""
    e = F.lower(F.trim(epoch))
    steps = sum(((t >= x).cast("double") for x in leaps[1:]), (t >= leaps[0]).cast("double"))
    return F.when(e.isin("j2000", "etime"), t).when(e == "i2000", t + 32.184).when(e == "ctime", t + steps + CTIME_OFFSET)


def parse_datetime(s: Column, fmt: str = "yyyy-DDD'T'HH:mm:ss") -> Column:
    """A timestamp, or null where the text doesn't match the format."""
    return F.try_to_timestamp(s, F.lit(fmt))


DOY = r"\d{4}-\d{3}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?"


def has_doy(s: Column) -> Column:
    """Whether :func:`parse_doy` finds a time in a text."""
    return s.rlike(DOY)


def parse_doy(s: Column) -> Column:
    """The first year and day-of-year time in a text, with T or a space and optional fraction; null on failure.

    It is looked for once; its fields stand at fixed places, and none can be read where there is no time.
    """
    found = F.regexp_extract(s, DOY, 0)
    num = lambda a, n: F.substring(found, a, n).try_cast("bigint")
    micros = F.rpad(F.substring(found, 19, 6), 6, "0").cast("bigint")
    day = F.unix_seconds(F.make_timestamp(num(1, 4).cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    sec = day + (num(6, 3) - 1) * 86400 + num(10, 2) * 3600 + num(13, 2) * 60 + num(16, 2)
    return F.timestamp_micros(sec * 1_000_000 + micros)


def parse_iso(s: Column) -> Column:
    """The first ISO date and time in a text; null on failure."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(s, r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?)", 1), F.lit("")))
