"""Event expressions: outcomes, UTC text, revisions, calendar buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome(home: Column, away: Column) -> Column:
    """0 home, 1 draw, 2 away; null while a score is missing."""
    return F.when(home > away, 0).when(home < away, 2).when(home == away, 1)


def usable_final() -> Column:
    return ((F.col("status") == "final") & F.col("outcome").isNotNull()
            & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())


_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def utc_instant(text: Column) -> Column:
    """ISO text to UTC wall clock. Text without an offset is read as UTC; unreadable text gives null.

    The offset is applied to the written clock, so the result never depends on the session time zone.
    """
    clean = F.trim(text)
    zone = F.replace(F.regexp_extract(clean, _ZONE, 1), F.lit(":"), F.lit(""))
    minutes = F.when(zone.rlike(r"^[+-]"), F.concat(F.substring(zone, 1, 1), F.lit("1")).cast("int") * (
        F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int"))).otherwise(0)
    clock = F.regexp_replace(clean, _ZONE, "").try_cast("timestamp_ntz")
    return clock - F.make_dt_interval(mins=minutes)


def utc_second(text: Column) -> Column:
    """``utc_instant`` without fractions of a second (offsets are whole minutes)."""
    return utc_instant(F.regexp_replace(text, r"(:\d{2})[.,]\d+", "$1"))


def iso_utc(text: Column) -> Column:
    return F.concat(F.replace(utc_second(text).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def event_time(clock: Column) -> Column:
    """Instant of a UTC wall clock, for watermarks, which need zoned timestamps."""
    return F.make_timestamp(F.year(clock), F.month(clock), F.dayofmonth(clock), F.hour(clock), F.minute(clock),
                            F.second(clock), F.lit("UTC"))


def utc_day(instant: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86400).cast("int"))


def revision(sport: Column, home: Column, away: Column, start: Column) -> Column:
    """Identity of the event itself; changes when it is moved or re-paired."""
    return F.sha2(F.concat_ws("|", sport, home, away, start.cast("timestamp_ntz").cast("string")), 256)


def season_year(start: Column) -> Column:
    """Season that a date belongs to when seasons turn in July."""
    return F.year(start) - F.when(F.month(start) >= 7, 0).otherwise(1)


def week_start(day: Column) -> Column:
    """Monday of the week."""
    return F.date_sub(day.cast("date"), F.weekday(day.cast("date")))


def available_day(start: Column, delay_hours: int = 48) -> Column:
    """First UTC day whose midnight is not before the result becomes available."""
    ready = start + F.expr(f"INTERVAL '{delay_hours}' HOUR")
    return F.date_add(ready.cast("date"), F.when(ready == ready.cast("date").cast("timestamp_ntz"), 0).otherwise(1))


# The outcome each probability position stands for.
OUTCOME_NAMES = ["home", "draw", "away"]
