"""Date functions: multi-format parse, month/season, shifts, epoch conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two day-first / ISO layouts the field sources use (one or
# two digits for day and month).
DATE_FORMATS = ("d/M/yyyy", "yyyy-M-d")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date_multi(c, formats=DATE_FORMATS) -> Column:
    """Parse text dates trying each layout in turn; unparseable -> NULL.

    Unlike an automatic parser this never reads dd/MM as MM/dd.  Every layout
    really gets its chance (the sequential fill in the field scripts only saw
    NULLs on its second attempt; here the evident intent is implemented).
    """
    # a time of day after the date is left out
    c = F.regexp_replace(F.trim(_c(c)), r"[ T][0-9]{1,2}:[0-9]{2}.*$", "")
    return F.coalesce(*[F.try_to_date(c, f) for f in formats])


def month_of(c) -> Column:
    """Calendar month 1..12 of a date (sample date or image date, caller's choice)."""
    return F.month(_c(c))


def season_of_month(m) -> Column:
    """Season code ``(month % 12 + 3) div 3``: Dec-Feb=1, Mar-May=2, Jun-Aug=3, Sep-Nov=4."""
    return F.floor((_c(m) % 12 + 3) / 3).cast("int")


def window_bounds(c, days: int):
    """Half-open search window ``[date - days, date + days)`` as timestamps."""
    d = _c(c).cast("date")
    return (F.date_sub(d, days).cast("timestamp_ntz"), F.date_add(d, days).cast("timestamp_ntz"))


def epoch_millis_to_date(c) -> Column:
    """Epoch milliseconds (UTC) -> DATE, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(_c(c) / F.lit(86400000)).cast("int"))


def format_iso(c) -> Column:
    """DATE -> 'yyyy-MM-dd' text."""
    return F.date_format(_c(c), "yyyy-MM-dd")
