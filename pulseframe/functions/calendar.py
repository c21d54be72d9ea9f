"""Calendar expressions. Sessions run in UTC; timestamps without a zone are cast at the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a day by hour, first hour included, last excluded.
DAY_PARTS = {"q1": (0, 6), "q2": (6, 12), "q3": (12, 18), "q4": (18, 24), "q234": (6, 24), "623": (6, 23), "1121": (11, 21)}
MINUTES = {"day": 1440, "quadrant": 360, "q234": 1080}


def day_part(time: Column, part: str) -> Column:
    first, last = DAY_PARTS[part]
    return (F.hour(time) >= first) & (F.hour(time) < last)


def jan_week(date: Column) -> Column:
    """Weeks of seven days counted from 1 January (not ISO weeks)."""
    return (F.floor((F.dayofyear(date) - 1) / 7) + 1).cast("int")


def season(date: Column) -> Column:
    """1 for December to February, then one for each three months."""
    return (F.floor((F.month(date) % 12) / 3) + 1).cast("int")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def auto_units(seconds: Column) -> Column:
    """Seconds up to a minute, minutes up to an hour, hours up to a day, days beyond: for results that mixed units."""
    return F.when(seconds < 60, seconds).when(seconds < 3600, seconds / 60).when(seconds < 86400, seconds / 3600).otherwise(seconds / 86400)
