"""Snapshot time and NTZ truncation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

TimeLike = str | dt.datetime | Column | None


def as_ntz(value: TimeLike) -> Column:
    """A TIMESTAMP_NTZ column from a string, datetime (an aware one as UTC) or
    column; None gives local now."""
    if value is None:
        return F.localtimestamp()
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:  # the tables hold UTC wall-clock times
            value = value.astimezone(dt.timezone.utc)
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp_ntz(F.lit(value))


def trunc_ntz(unit: str, col: Column | str) -> Column:
    """date_trunc for ``day``, ``hour`` and ``minute`` that stays TIMESTAMP_NTZ
    (Spark's date_trunc goes through the session zone, where an hour can be
    missing): the day through DATE, plus the hours and minutes as an interval."""
    col = F.col(col) if isinstance(col, str) else col
    day = col.cast("date").cast("timestamp_ntz")
    if unit == "day":
        return day
    if unit == "hour":
        return day + F.make_dt_interval(F.lit(0), F.hour(col))
    if unit == "minute":
        return day + F.make_dt_interval(F.lit(0), F.hour(col), F.minute(col))
    raise ValueError(f"unknown unit {unit!r}")


def resolve_snapshot(snapshot_time: TimeLike, now: TimeLike = None) -> Column:
    """Snapshot used by every filter: a future input becomes the start of today,
    otherwise the start of the given day.

    Built from literals only, so Catalyst folds it to a constant and the
    ``block_timestamp <= snapshot`` filters reach the Parquet scan.
    """
    snap = as_ntz(snapshot_time)
    current = as_ntz(now)
    return (
        F.when(snap > trunc_ntz("minute", current), trunc_ntz("day", current))
        .otherwise(trunc_ntz("day", snap))
    )
