"""Dates, times and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hms_part(column: Column, start: int) -> Column:
    """Two digits at a position of an HH:MM:SS string, null if they are not digits."""
    return F.substring(column, start, 2).try_cast("int")


def hms_seconds(column: Column) -> Column:
    """HH:MM:SS, with anything after it, as seconds."""
    return hms_part(column, 1) * 3600 + hms_part(column, 4) * 60 + hms_part(column, 7)


def date_of_parts(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts, null if there is no such day."""
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def epoch_seconds(column: Column) -> Column:
    return F.unix_timestamp(column)
