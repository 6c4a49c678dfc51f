"""Date expressions. "Today" is always an argument; nothing reads the wall clock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

LOCAL_ZONE = "Asia/Kolkata"

# The holiday calendar, month and day.
HOLIDAYS = [
    ("Republic Day", 1, 26),
    ("Holi", 3, 25),
    ("Good Friday", 4, 18),
    ("Eid ul-Fitr", 4, 10),
    ("Independence Day", 8, 15),
    ("Gandhi Jayanti", 10, 2),
    ("Navratri", 10, 3),
    ("Dussehra", 10, 12),
    ("Diwali", 10, 20),
    ("Christmas", 12, 25),
    ("New Year", 1, 1),
    ("Pongal", 1, 14),
    ("Onam", 9, 5),
]
HOLIDAY_REACH_DAYS = 1

AsOf = dt.date | str | Column | None


def latest(df: DataFrame, col: str, as_of: AsOf = None) -> Column:
    """The planning date: the given one, or the newest date in ``df`` as a scalar subquery.

    The subquery is resolved by the executors before the outer scan starts, so
    it prunes like a literal and nothing is collected by this call.
    """
    if as_of is None:
        return df.select(F.max(F.to_date(col))).scalar()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(str(as_of)).cast("date")


def to_local(col: Column) -> Column:
    """UTC text to local time; malformed text to NULL."""
    return F.from_utc_timestamp(F.try_to_timestamp(col), LOCAL_ZONE)


def parse_day_first(col: Column, fallback: Column | None = None) -> Column:
    """``dd-MM-yyyy`` text to a date, else the fallback."""
    parsed = F.try_to_timestamp(col, F.lit("dd-MM-yyyy")).cast("date")
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def week_start(col: Column) -> Column:
    """Monday of the ISO week."""
    return F.date_trunc("week", col).cast("date")


def near_holiday(day: Column) -> Column:
    """1 within a day of a listed holiday, in any year.

    The window is a set of (month, day) pairs, so no calendar has to be
    generated per year and joined. No listed holiday touches 29 February,
    where the pairs would depend on the year.
    """
    reach = range(-HOLIDAY_REACH_DAYS, HOLIDAY_REACH_DAYS + 1)
    pairs = {
        ((base + dt.timedelta(days=k)).month, (base + dt.timedelta(days=k)).day)
        for _, month, dom in HOLIDAYS
        for base in [dt.date(2001, month, dom)]
        for k in reach
    }
    codes = sorted(month * 100 + dom for month, dom in pairs)
    return (F.month(day) * 100 + F.dayofmonth(day)).isin(codes).cast("int")
