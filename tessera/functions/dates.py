"""Date functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mail_date(text: Column) -> Column:
    """A mail date without its weekday and its zone; it stays text."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[A-Za-z]{3},\s*", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+[+-]\d{4}(?:\s+\([^)]*\))?$", ""))


def record_datetime(text: Column) -> Column:
    """ISO, ``m/d/yyyy`` or ``d-Mon-yyyy`` text as ``yyyy-MM-dd HH:mm:ss`` in UTC; null if it is none of them."""
    bare = F.trim(text)
    iso = F.replace(bare, F.lit("Z"), F.lit("+00:00"))
    found = F.coalesce(
        F.try_to_timestamp(F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}"), iso)),
        F.try_to_timestamp(F.when(bare.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), bare), F.lit("M/d/yyyy")),
        F.try_to_timestamp(F.when(bare.rlike(r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"), F.initcap(bare)), F.lit("d-MMM-yyyy")),
    )
    return F.date_format(found, "yyyy-MM-dd HH:mm:ss")


def day_bounds(first: Column, last: Column) -> Column:
    """A range of whole days as ``since <= t < before``."""
    return F.struct(first.cast("date").alias("since"), F.date_add(last.cast("date"), 1).alias("before"))


def epoch(text: Column) -> Column:
    """Seconds since 1970 of an ISO instant; ``Z`` is understood."""
    return F.unix_timestamp(F.try_to_timestamp(F.replace(text, F.lit("Z"), F.lit("+00:00"))))


def poll_minutes(instant: Column, zone: str = "Asia/Hong_Kong") -> Column:
    """1 in business hours, from 9 until before 18 local time, else 5."""
    hour = F.hour(F.from_utc_timestamp(instant, zone))
    return F.when((hour >= 9) & (hour < 18), 1).otherwise(5)


def expires_soon(now: Column, end: Column, within: int = 1800) -> Column:
    """Whether less than ``within`` seconds are left, and more than none."""
    left = F.unix_timestamp(end) - F.unix_timestamp(now)
    return (left > 0) & (left < within)
