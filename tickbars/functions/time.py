"""Trade dates and times.

The exchange sends wall-clock text, so event time is `timestamp_ntz`: its parsing and bucketing do
not depend on the session time zone. Structured Streaming takes watermarks on `timestamp` only;
`to_instant` and `from_instant` convert by reading the wall clock as UTC, again whatever the session
zone is.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def check_minutes(minutes: int) -> int:
    """Candles restart every hour, so their width has to divide 60."""
    if not isinstance(minutes, int) or minutes <= 0 or 60 % minutes:
        raise ValueError(f"minutes must be a positive divisor of 60, got {minutes!r}")
    return minutes


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


# The larger expressions are SQL text: one call into the JVM instead of one per operator.
_PADDED = "octet_length({d}) = 10 and locate('.', {d}) = 3 and locate('.', {d}, 4) = 6"
_LOOSE = "{d} rlike '^[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}$'"
# yyyy-MM-dd by position, and yyyy-M-d by separator.
_ISO = "substring({d}, 7, 4), '-', substring({d}, 4, 2), '-', substring({d}, 1, 2)"
_ISO_SPLIT = "split_part({d}, '.', 3), '-', split_part({d}, '.', 2), '-', split_part({d}, '.', 1)"


def event_time(date: str, time: str) -> Column:
    """`timestamp_ntz` from columns of dd.MM.yyyy and HH:mm:ss text; NULL if the text is no such time.

    Zero-padded days, the usual case, are re-ordered by position and cast, which costs a fraction of
    a pattern parse. Others (`1.9.2021`) are matched with a regular expression first. The zero fraction
    that is added to the time makes the cast refuse what it would take otherwise: times without
    seconds, with a fraction, or with a zone.
    """
    sql = f"""case
        when {_PADDED} then try_cast(concat({_ISO}, ' ', {{t}}, '.0') as timestamp_ntz)
        when {_LOOSE} then try_cast(concat({_ISO_SPLIT}, ' ', {{t}}, '.0') as timestamp_ntz)
    end"""
    return F.expr(sql.format(d=_name(date), t=_name(time)))


def trade_day(date: str) -> Column:
    """`date` from a column of dd.MM.yyyy text; NULL if the text is no such day."""
    sql = f"""case
        when {_PADDED} then try_cast(concat({_ISO}) as date)
        when {_LOOSE} then try_cast(concat({_ISO_SPLIT}) as date)
    end"""
    return F.expr(sql.format(d=_name(date)))


def hour_text(time: Column | str) -> Column:
    """Hour part of HH:mm:ss text, as text."""
    return F.split_part(_col(time), F.lit(":"), F.lit(1))


def minute_of_hour(time: Column | str) -> Column:
    """Minute part of HH:mm:ss text."""
    return F.split_part(_col(time), F.lit(":"), F.lit(2)).try_cast("int")


def tick_number(time: Column | str, minutes: int = 5) -> Column:
    """Number of the candle within its hour."""
    return F.floor(minute_of_hour(time) / check_minutes(minutes)).cast("int")


def bucket_start(when: Column | str, minutes: int = 5) -> Column:
    """Start of the candle that an event time falls into."""
    return F.window(_col(when), f"{check_minutes(minutes)} minutes")["start"]


def to_instant(when: Column | str) -> Column:
    """`timestamp` whose UTC clock reads like the given `timestamp_ntz` (whole seconds)."""
    since = F.col(when) if isinstance(when, str) else when
    return F.timestamp_seconds((since - F.expr(_EPOCH)).cast("interval second").cast("bigint"))


def from_instant(when: Column | str) -> Column:
    """Inverse of `to_instant`."""
    zero = F.lit(0)
    return F.expr(_EPOCH) + F.make_dt_interval(zero, zero, zero, F.unix_seconds(_col(when)))


def shift_day(day: Column | str, days: int) -> Column:
    return F.date_add(_col(day), days)


def iso_day(day: Column | str) -> Column:
    """yyyy-MM-dd text of a `date`."""
    return _col(day).cast("string")


def day_spellings(day: dt.date) -> list[str]:
    """The texts of a Python date that the trades table may hold: dd.MM.yyyy, each part with or without its zero."""
    days, months = ({f"{n:02d}", str(n)} for n in (day.day, day.month))
    return sorted(f"{d}.{m}.{day.year:04d}" for d in days for m in months)
