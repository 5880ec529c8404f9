"""Time expressions on zone-less timestamps. None of them depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(n: int) -> Column:
    return F.expr(f"INTERVAL '{n}' SECOND")


def hour_of(ts) -> Column:
    return F.hour(ts)


def day_of(ts) -> Column:
    return F.to_date(ts)


def weekday_name(ts) -> Column:
    return F.date_format(F.to_date(ts), "EEEE")


def month_name(ts) -> Column:
    return F.date_format(F.to_date(ts), "MMMM")


def ts_text(ts) -> Column:
    """``yyyy-MM-dd HH:mm:ss``."""
    return F.substring(F.col(ts).cast("string") if isinstance(ts, str) else ts.cast("string"), 1, 19)


def elapsed_seconds(start: Column, end: Column) -> Column:
    """Seconds between two zone-less timestamps, microseconds kept."""
    return (end - start).cast("decimal(20,6)")


def slice_start(ts, width_seconds: int) -> Column:
    """Start of the fixed-width time slice holding ``ts``."""
    return F.window(ts, f"{width_seconds} seconds")["start"]
