"""People-friendly dates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as_of(as_of: datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def _ago(n: Column, unit: str) -> Column:
    return F.concat(
        n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago")
    )


def friendly_date(ts: str | Column, as_of: datetime) -> Column:
    """How long before `as_of`, in words; dates in full for the future and for other years."""
    ts, now = _col(ts), _as_of(as_of)
    seconds = F.timestamp_diff("SECOND", ts, now)
    days = F.datediff(now, ts)
    full = F.date_format(ts, "d MMM yyyy")
    return (
        F.when(ts > now, full)
        .when(seconds < 60, "just now")
        .when(seconds < 3600, _ago(F.floor(seconds / 60), "minute"))
        .when(days == 0, _ago(F.floor(seconds / 3600), "hour"))
        .when(days == 1, "Yesterday")
        .when(days < 7, F.date_format(ts, "EEEE"))
        .when(F.year(ts) == as_of.year, F.date_format(ts, "EEE d MMM"))
        .otherwise(full)
    )


def day_section(ts: str | Column, as_of: datetime) -> Column:
    """Heading a list is divided by."""
    days = F.datediff(_as_of(as_of), _col(ts))
    return (
        F.when(days < 0, "Upcoming")
        .when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days < 7, "This week")
        .otherwise("Older")
    )
