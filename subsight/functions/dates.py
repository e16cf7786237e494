"""Date and time expressions.

The reference's day arithmetic is T-SQL: DATEADD keeps the time of day,
DATEDIFF(DAY, a, b) counts midnights crossed. ``as_of`` is always passed
in as a literal so that filters fold and push down."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import add_days, ts_ntz  # noqa: F401  (re-export)

AsOf = "str | _dt.datetime | Column"


def lit_ts(value) -> Column:
    """Literal TIMESTAMP_NTZ from text, datetime or date (a Column passes through)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(value, _dt.date):
        value = value.strftime("%Y-%m-%d 00:00:00")
    elif len(str(value)) == 10:
        value = f"{value} 00:00:00"
    return ts_ntz(str(value))


def in_range(col: Column, date_from=None, date_to=None) -> Column:
    """Lower bound inclusive, upper bound ``< to + 1 day``; each optional.

    The upper bound adds one day to the value given, time of day included
    (a 'to' of now reaches 24 hours ahead, as in the reference)."""
    cond = F.lit(True)
    if date_from is not None:
        cond = cond & (col >= lit_ts(date_from))
    if date_to is not None:
        cond = cond & (col < add_days(lit_ts(date_to), 1))
    return cond


def day_diff(end: Column, start: Column) -> Column:
    """DATEDIFF(DAY, start, end): midnights crossed between the two."""
    return F.datediff(F.to_date(end), F.to_date(start))


def remaining_days(end: Column, as_of, duration: Column) -> Column:
    """max(0, days from as_of's date to end's date), at most the duration."""
    d = day_diff(end, lit_ts(as_of))
    return F.least(F.greatest(d, F.lit(0)), duration)


def renewal_end(end: Column, as_of, duration: Column, times: Column | int = 1) -> Column:
    """max(end, as_of) + duration days (times renewals in a row)."""
    t = times if isinstance(times, Column) else F.lit(times)
    return add_days(F.greatest(end, lit_ts(as_of)), duration * t)
