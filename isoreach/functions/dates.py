"""Dates and times of schedules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def each_date(start: Column, end: Column) -> Column:
    """All dates from start to end, both included."""
    return F.sequence(start, end)


def step_date(date: Column, days: Column | int) -> Column:
    """A date moved by days, forward or back."""
    return F.date_add(date, days)


def in_calendar(date: Column, start: Column, end: Column, weekdays: Column) -> Column:
    """Whether a date is in a calendar: in its range and on one of its weekdays.

    ``weekdays`` holds seven booleans from Sunday on.
    """
    return date.between(start, end) & F.coalesce(F.get(weekdays, F.dayofweek(date) - 1), F.lit(False))


def tolerance_window(target: Column, start: Column, end: Column, days: int) -> Column:
    """Dates of a calendar range within some days of a target; empty if there are none."""
    lo, hi = F.greatest(start, F.date_sub(target, days)), F.least(end, F.date_add(target, days))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<date>"))


def start_plus(start: Column, seconds: Column) -> Column:
    """The clock time after so many (fractional) seconds of a trip."""
    return F.timestamp_add("MICROSECOND", F.round(seconds * 1_000_000).cast("long"), start)


def onto_date(moment: Column, mapping: Column) -> Column:
    """A moment on the picked date of its own, if the map has one; the time stays."""
    picked = F.element_at(mapping, F.to_date(moment))
    return F.when(picked.isNull(), moment).otherwise(F.timestamp_add("DAY", F.date_diff(picked, F.to_date(moment)), moment))


def back_to_date(departure: Column, now: Column, mapped: Column) -> Column:
    """A found departure moved back by the days that ``now`` was moved forward."""
    return F.timestamp_add("DAY", -F.date_diff(F.to_date(mapped), F.to_date(now)), departure)


def shifted(departure: Column, seconds: Column) -> Column:
    """A departure plus a delta; null where that is no valid time."""
    finite = ~F.isnan(seconds) & (F.abs(seconds) < F.lit(3.2e11))
    return F.when(finite, start_plus(departure, seconds))
