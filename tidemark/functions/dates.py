"""Epoch seconds and dates, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86_400


def epoch_date(seconds: Column) -> Column:
    """UTC date of epoch seconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int"))


def epoch_seconds(moment: Column) -> Column:
    """Whole seconds since the epoch of a date or a timestamp without time zone, read as UTC."""
    days = F.datediff(F.to_date(moment), F.lit("1970-01-01").cast("date")).cast("long")
    stamp = moment.cast("timestamp_ntz")
    return days * DAY + F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)
