"""Dates, times and weekdays. All times are UTC instants; schedules use a fixed offset of eight hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
FUTURE_MINUTES, STALE_DAYS, ONE_SHOT_DAYS = 10, 14, 21
SCHEDULE_OFFSET_HOURS, DUE_HOUR, GRACE_HOURS = 8, 8, 6


def timestamp_of(text: Column) -> Column:
    """ISO text (a space may stand for the T; no zone means UTC) or a bare date to a timestamp, else NULL."""
    s = F.trim(text)
    return F.when(s.rlike(DATE) | s.rlike(ISO), F.try_to_timestamp(F.regexp_replace(s, " ", "T")))


def aware_timestamp_of(text: Column) -> Column:
    """Only text that names its zone."""
    s = F.trim(text)
    return F.when(s.rlike(ISO) & s.rlike(ZONE), timestamp_of(s))


def strict_date_of(text: Column) -> Column:
    """A real calendar date written as YYYY-MM-DD, else NULL."""
    return F.when(F.trim(text).rlike(DATE), F.to_date(F.try_to_timestamp(F.trim(text))))


def lenient_date_of(text: Column) -> Column:
    """The date that the first ten characters are."""
    return strict_date_of(F.substring(F.trim(text), 1, 10))


def missing_update_time(date: Column) -> Column:
    """The update time that an observation without one has: its day's midnight, as text."""
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("T00:00:00Z"))


def effective_time(update_ts: Column, date: Column) -> Column:
    return F.coalesce(update_ts.cast("timestamp"), date.cast("timestamp"))


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def weekdays_until(date: Column) -> Column:
    """Weekdays from Monday 1969-12-29 up to and with ``date``."""
    k = F.datediff(date, F.lit("1969-12-29").cast("date"))
    return 5 * F.floor(k / 7) + F.least(F.pmod(k, F.lit(7)) + 1, F.lit(5))


def weekday_gap(a: Column, b: Column) -> Column:
    """Mondays to Fridays after ``a``, up to and with ``b``."""
    return F.greatest(F.lit(0), weekdays_until(b) - weekdays_until(a)).cast("long")


def baseline_gap_allowed(baseline: Column, target: Column, tolerance: int = 1) -> Column:
    return (baseline <= target) & (weekday_gap(baseline, target) <= tolerance)


def age_days(event: Column, now: Column) -> Column:
    """Whole days since ``event``, never below zero."""
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(now) - F.unix_timestamp(event)) / 86400)).cast("long")


def is_active(status: Column, event: Column, expires: Column, now: Column, one_shot: Column) -> Column:
    """Open, not resolved, not past its expiry (the moment itself still counts); a one-shot without an expiry lives 21 days."""
    until = F.coalesce(expires, F.when(one_shot, event + F.expr(f"INTERVAL {ONE_SHOT_DAYS} DAYS")))
    return F.coalesce(F.lower(status) != "resolved", F.lit(True)) & F.coalesce(now <= until, F.lit(True))


def last_due(now: Column) -> Column:
    """The latest weekday 08:00 at +08:00 that has passed, as a UTC instant."""
    local = now + F.expr(f"INTERVAL {SCHEDULE_OFFSET_HOURS} HOURS")
    day = F.to_date(local - F.expr(f"INTERVAL {DUE_HOUR} HOURS"))
    n = F.weekday(day)  # Monday is 0
    day = F.date_sub(day, F.when(n == 5, 1).when(n == 6, 2).otherwise(0))
    return day.cast("timestamp") + F.expr(f"INTERVAL {DUE_HOUR - SCHEDULE_OFFSET_HOURS} HOURS")


def next_due(now: Column) -> Column:
    day = F.to_date(last_due(now) + F.expr(f"INTERVAL {SCHEDULE_OFFSET_HOURS} HOURS"))
    n = F.weekday(day)
    day = F.date_add(day, F.when(n == 4, 3).otherwise(1))
    return day.cast("timestamp") + F.expr(f"INTERVAL {DUE_HOUR - SCHEDULE_OFFSET_HOURS} HOURS")


def is_stale(last_success: Column, now: Column) -> Column:
    """No success since the last due time whose grace period is over; never collected is stale."""
    due = last_due(now - F.expr(f"INTERVAL {GRACE_HOURS} HOURS"))
    return last_success.isNull() | (last_success < due)


def display_time(ts: Column) -> Column:
    return F.date_format(ts + F.expr(f"INTERVAL {SCHEDULE_OFFSET_HOURS} HOURS"), "yyyy-MM-dd HH:mm")
