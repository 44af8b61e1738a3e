"""UTC buckets, and the windows of a range as plain values."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}
MAX_DAYS, MAX_HOURLY_DAYS = 366, 62


def day_utc(ts: Column) -> Column:
    return F.to_date(ts)


def hour_utc(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def week_bucket(ts: Column) -> Column:
    """The Monday of the week."""
    return F.to_date(F.date_trunc("week", ts))


def bucket_of(grain: str, ts: Column) -> Column:
    return {"hour": hour_utc, "day": day_utc, "week": week_bucket}[grain](ts)


def bucket_end(grain: str, bucket: Column) -> Column:
    return bucket.cast("timestamp") + F.expr(GRAINS[grain])


def prior_window(start: date | datetime, end: date | datetime, grain: str = "day") -> tuple:
    """The window of equal length that ends just before `start`; in hours for the hour grain, else in days."""
    step = timedelta(hours=1) if grain == "hour" else timedelta(days=1)
    span = end - start
    return start - step - span, start - step


def prior_prior_window(start, end, grain: str = "day") -> tuple:
    return prior_window(*prior_window(start, end, grain), grain)


def context_window(start: date, end: date, lookback: int = 30) -> tuple[date, date]:
    """From the earlier of the prior window's start and `lookback` days before, up to the day before `start`."""
    return min(prior_window(start, end)[0], start - timedelta(days=lookback)), start - timedelta(days=1)


def clamp_range(start: date, end: date, first: date | None) -> tuple[date, date]:
    """No earlier than the first indexed day; a range wholly before it becomes that day."""
    if first is None or start >= first:
        return start, end
    return first, max(end, first)


def validate_range(start: str, end: str, grain: str) -> tuple[date, date]:
    """ISO days, in order, and no longer than the grain allows. Raises ValueError otherwise."""
    try:
        a, b = (date.fromisoformat(x) for x in (start, end))
    except (TypeError, ValueError) as e:
        raise ValueError("days must be YYYY-MM-DD") from e
    if not (len(start) == len(end) == 10):
        raise ValueError("days must be YYYY-MM-DD")
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain}")
    most = MAX_HOURLY_DAYS if grain == "hour" else MAX_DAYS
    if a > b:
        raise ValueError("the range ends before it starts")
    if (b - a).days + 1 > most:
        raise ValueError(f"at most {most} days for this grain")
    return a, b
