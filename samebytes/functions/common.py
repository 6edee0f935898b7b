"""Small helpers shared by the column functions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that trimming a path, key or name removes, as a Java regex class.
_BLANK = r"[\s\p{Z}\x1c-\x1f\x85]"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_timestamp(now: Column | datetime | str) -> Column:
    """A fixed clock as a column; naive datetimes and text are read as UTC."""
    if isinstance(now, Column):
        return now
    if isinstance(now, str):
        now = datetime.fromisoformat(now)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit((now - epoch) // timedelta(microseconds=1)))


def seconds(value: Column | int) -> Column:
    """A day-time interval of whole seconds."""
    return F.make_dt_interval(secs=F.lit(value) if isinstance(value, int) else value)


def strip(value: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col(value), f"^{_BLANK}+|{_BLANK}+$", "")


def is_blank(value: Column | str) -> Column:
    value = col(value)
    return value.isNull() | (F.trim(value) == "")


def default_if_blank(value: Column | str, default: Column | str) -> Column:
    """keep the value unless it is NULL or blank."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(is_blank(value), fallback).otherwise(col(value))


def verdict(*checks: tuple[Column, str]) -> Column:
    """First failing check wins; yields `struct(ok, reason)` with reason NULL when fine."""
    reason = F.lit(None).cast("string")
    for failed, name in reversed(checks):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def utc(value: Column | str) -> Column:
    """read a timestamp without zone as UTC, whatever the session zone is."""
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(0)) + (col(value).cast("timestamp_ntz") - epoch)
