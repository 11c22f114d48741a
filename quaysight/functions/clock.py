"""Clock, calendar and date-format expressions.

Every report takes its clock as a parameter ``as_of`` (a datetime, an ISO
string, or a Column such as ``F.current_timestamp()`` cast to timestamp_ntz)
instead of reading the wall clock, so a run can be repeated exactly.  With a
literal ``as_of`` all the window bounds below fold to constants and the
comparisons are pushed into the parquet scan as ranges.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaysight.functions.semantics import ColumnOrName, col

AsOf = dt.datetime | dt.date | str | Column

# Date masks of the reports and their Spark equivalents.
MASK_DAY_MONTH_YEAR_TIME = "dd/MM/yy HH:mm"   # DD/MM/YY HH24:Mi
MASK_DAY_MONTH = "dd/MM"                      # DD/MM
MASK_TIME = "HH:mm"                           # HH24:Mi
MASK_DAY_MONTH_TIME = "dd/MM HH:mm"           # DD/MM HH24:Mi


def as_of_col(as_of: AsOf) -> Column:
    """The clock as a timestamp_ntz column."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, dt.datetime):
        as_of = as_of.isoformat(sep=" ")
    elif isinstance(as_of, dt.date):
        as_of = as_of.isoformat() + " 00:00:00"
    return F.lit(str(as_of)).cast("timestamp_ntz")


def day(ts: ColumnOrName) -> Column:
    """TRUNC(ts): the calendar day."""
    return F.to_date(col(ts))


def midnight(d: Column) -> Column:
    """TRUNC(d) as a timestamp (00:00:00 of that day)."""
    return F.to_date(d).cast("timestamp_ntz")


def after_day_offset(ts: ColumnOrName, as_of: AsOf, days_back: int) -> Column:
    """TRUNC(ts) > TRUNC(as_of - days_back)."""
    return day(ts) > F.date_sub(F.to_date(as_of_col(as_of)), days_back)


def between_midnights(ts: ColumnOrName, as_of: AsOf, from_days_back: int, to_days_back: int) -> Column:
    """ts BETWEEN TRUNC(as_of - from) AND TRUNC(as_of - to), on the raw ts.

    The upper bound is a midnight, so of its day only 00:00:00 is admitted.
    """
    today = F.to_date(as_of_col(as_of))
    lo = F.date_sub(today, from_days_back).cast("timestamp_ntz")
    hi = F.date_sub(today, to_days_back).cast("timestamp_ntz")
    return col(ts).between(lo, hi)


def iso_weekday(d: Column) -> Column:
    """1 = Monday ... 7 = Sunday, i.e. 1 + TRUNC(d) - TRUNC(d, 'IW')."""
    return F.weekday(d) + 1


def business_days_ahead(today: Column, friday: int = 5, friday_ahead: int = 3, other_ahead: int = 1) -> Column:
    """Days from a day to the next working day: 3 on a Friday, else 1."""
    return F.when(iso_weekday(today) == friday, F.lit(friday_ahead)).otherwise(F.lit(other_ahead))


def business_day_window(ts: ColumnOrName, as_of: AsOf, friday: int = 5,
                        friday_ahead: int = 3, other_ahead: int = 1) -> Column:
    """TRUNC(ts) BETWEEN TRUNC(as_of) AND TRUNC(as_of + (Friday ? 3 : 1)).

    On a Friday the window reaches over the weekend to Monday.  ISO weekday
    numbering, independent of any locale.
    """
    today = F.to_date(as_of_col(as_of))
    return day(ts).between(today, F.date_add(today, business_days_ahead(today, friday, friday_ahead, other_ahead)))


def minutes_of_day_since(as_of: AsOf, ts: ColumnOrName) -> Column:
    """EXTRACT(HOUR FROM as_of - ts) * 60 + EXTRACT(MINUTE FROM as_of - ts).

    The interval's whole days are dropped (two days and 2h03 give 123);
    negative when ts is later than as_of.
    """
    gap = as_of_col(as_of) - col(ts)
    return (F.extract(F.lit("HOUR"), gap) * 60 + F.extract(F.lit("MINUTE"), gap)).cast("long")


def minutes_since(as_of: AsOf, ts: ColumnOrName) -> Column:
    """ROUND((as_of - ts) * 24 * 60) with ts held to whole seconds.

    Rounds half away from zero; ``timestampdiff(MINUTE)`` would truncate.
    """
    seconds = F.unix_timestamp(as_of_col(as_of)) - F.unix_timestamp(col(ts))
    return F.round(seconds / F.lit(60.0), 0).cast("long")


def to_char(ts: ColumnOrName, mask: str) -> Column:
    return F.date_format(col(ts), mask)
