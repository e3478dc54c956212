"""Calendar expressions: week numbers, decimal years, multi-day bins, fixed-length calendars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day indices at which a 360-day year jumps over the 31st of a month.
JUMPS_360 = (150, 210, 240, 300)
JUMP_360_LEAP = 90
# Fixed value: day index at which a 365-day year jumps over Feb 29 in a leap year.
JUMP_365_LEAP = 59


def is_leap_year(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def days_in_year(date: Column) -> Column:
    return F.when(is_leap_year(F.year(date)), F.lit(366)).otherwise(F.lit(365))


def is_leap_day(date: Column) -> Column:
    return (F.month(date) == 2) & (F.dayofmonth(date) == 29)


def week_of_year(date: Column) -> Column:
    """Seven-day weeks counted from Jan 1 (1 to 53), not ISO weeks."""
    return F.floor((F.dayofyear(date) - 1) / 7).cast("int") + 1


def decimal_year(date: Column) -> Column:
    return F.year(date) + (F.dayofyear(date) - 1) / days_in_year(date)


def bins_per_year(k: int) -> int:
    return math.ceil(365 / k)


def xday_bin(date: Column, k: int = 5, first_year: int | None = None, last_year: int | None = None) -> Column:
    """Start date of the k-day bin; bins restart every Jan 1 and the last one takes the rest of the year.

    On request, dates before ``first_year``, and on or after the last bin start of ``last_year``, have no bin.
    """
    last = bins_per_year(k) - 1
    index = F.least(F.floor((F.dayofyear(date) - 1) / k), F.lit(last)).cast("int")
    jan1 = F.trunc(date, "year")
    inside = F.lit(True)
    if first_year is not None:
        inside &= date >= F.lit(f"{first_year}-01-01").cast("date")
    if last_year is not None:
        inside &= date < F.date_add(F.lit(f"{last_year}-01-01").cast("date"), last * k)
    return F.when(inside, F.date_add(jan1, index * k))


def noleap_to_date(days_since: Column, since: str = "2001-01-01", year_length: int = 365) -> Column:
    """Date of a day count in a calendar whose years all have ``year_length`` (365 or 360) days."""
    if year_length not in (365, 360):
        raise ValueError("year_length must be 365 or 360")
    if not since.endswith("-01-01"):
        raise ValueError("since must be a first of January: the years of the calendar start there")
    start = F.add_months(F.lit(since).cast("date"), (F.floor(days_since / year_length) * 12).cast("int"))
    day = F.pmod(F.floor(days_since).cast("int"), F.lit(year_length))
    leap = is_leap_year(F.year(start))

    def jumped(at: int) -> Column:
        return (day >= at).cast("int")

    if year_length == 365:
        shift = F.when(leap, jumped(JUMP_365_LEAP)).otherwise(F.lit(0))
    else:
        shift = F.when(leap, jumped(JUMP_360_LEAP)).otherwise(F.lit(0))
        for at in JUMPS_360:
            shift = shift + jumped(at)
    return F.date_add(start, day + shift)
