"""Dates and windows. Everything is UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Epoch seconds of years 1 to 9999; what lies outside is no date.
EPOCH_RANGE = (-62135596800, 253402300799)


def epoch_to_timestamp(seconds: Column) -> Column:
    seconds = seconds.cast("double")
    return F.when(seconds.between(*EPOCH_RANGE), F.timestamp_micros((seconds * 1e6).cast("long")))


def published_at(published: Column, updated: Column) -> Column:
    """The first usable of two epoch fields."""
    return F.coalesce(epoch_to_timestamp(published), epoch_to_timestamp(updated))


def iso_to_epoch(c: Column) -> Column:
    """ISO 8601 to epoch seconds; without a zone it is UTC, what does not parse is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_timestamp(F.try_to_timestamp(c)))


def in_window(ts: Column, since: Column | None = None, until: Column | None = None) -> Column:
    """Half-open window; a null timestamp is always inside."""
    inside = F.lit(True)
    if since is not None:
        inside = inside & (ts >= since)
    if until is not None:
        inside = inside & (ts < until)
    return ts.isNull() | inside


def close_in_time(a: Column, b: Column, hours: int) -> Column:
    return a.isNull() | b.isNull() | (F.abs(F.unix_micros(a) - F.unix_micros(b)) <= hours * 3_600_000_000)


def week_start(ts: Column) -> Column:
    """Monday of the ISO week, midnight."""
    return F.date_trunc("week", ts)


def iso_week_label(ts: Column) -> Column:
    year = F.extract(F.lit("YEAROFWEEK"), ts).cast("string")
    return F.concat(F.lit("W"), year, F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def trailing_label(end: Column, days: int) -> Column:
    return F.concat(F.lit("D"), F.date_format(end, "yyyy-MM-dd"), F.lit(f"-{days}d"))


def range_label(start: Column, end: Column) -> Column:
    return F.concat(F.lit("R"), F.date_format(start, "yyyy-MM-dd"), F.lit("-to-"), F.date_format(end, "yyyy-MM-dd"))


def age_days(then: Column, now: Column) -> Column:
    """Whole days between, by seconds (not by midnights crossed)."""
    return F.floor((F.unix_seconds(now) - F.unix_seconds(then)) / 86400)
