"""Times of day as seconds, which may pass 24 hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_seconds(text: Column) -> Column:
    """``HH:MM:SS`` to seconds; null unless there are exactly three whole numbers."""
    parts = F.split(F.trim(text), ":")
    h, m, s = (F.get(parts, i).try_cast("int") for i in range(3))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)


def lenient_int(text: Column, default: int = 0) -> Column:
    """Whole part of a number in a text, the default where there is none."""
    return F.coalesce(text.try_cast("double").try_cast("int"), F.lit(default))


def hhmm(seconds: Column) -> Column:
    """``HH:MM``, wrapped at 24 hours."""
    s = seconds.cast("long") % 86400
    return F.format_string("%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60))


def hhmmss(seconds: Column) -> Column:
    """``HH:MM:SS``, hours not wrapped."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def rollover(times: Column) -> Column:
    """Sorted stop times of a trip past midnight: a day is added to a time below the one before
    (as adjusted) until it isn't."""
    day = 86400

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        short = F.ceil((last - t) / day)
        return F.concat(done, F.array(F.when((F.size(done) > 0) & (t < last), t + short * day).otherwise(t).cast("long")))

    return F.aggregate(times, F.array().cast("array<long>"), step)


def short_to_seconds(text: Column) -> Column:
    """``HH:MM`` to seconds; null for other texts."""
    parts = F.split(F.trim(text), ":")
    return F.when(F.size(parts) >= 2, F.get(parts, 0).try_cast("int") * 3600 + F.get(parts, 1).try_cast("int") * 60)
