"""Exchange sessions: wall-clock minutes, session day and minute, clocks, contracts.

A session ends at 17:00 New York time and starts at 18:00 of the evening before, so wall-clock
minutes are shifted by six hours: ``sday`` counts the days of the end date, ``sm`` the minutes from 18:00.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT, DAY = 360, 1440
#: Session minutes of the regular hours, and of the window in which the next bar can be traded.
RTH_OPEN, RTH_CLOSE, LAST_ENTRY, SESSION_END = 930, 1320, 1290, 1379


def utc_minutes(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 60_000_000).cast("bigint")


def wall_minutes(ts: Column, zone: str = "America/New_York") -> Column:
    """Minutes since 1970 on the zone's wall clock."""
    return F.floor(F.unix_micros(F.from_utc_timestamp(ts, zone)) / 60_000_000).cast("bigint")


def session_fields(ts: Column, zone: str = "America/New_York") -> dict[str, Column]:
    """tmin, local, sday and sm of a UTC instant."""
    local = wall_minutes(ts, zone)
    return {
        "tmin": utc_minutes(ts),
        "local": local,
        "sday": F.floor((local + SHIFT) / DAY).cast("int"),
        "sm": F.pmod(local + SHIFT, F.lit(DAY)).cast("smallint"),
    }


def session_date(sday: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), sday)


def session_bounds(sday: Column, zone: str = "America/New_York") -> tuple[Column, Column]:
    """UTC minutes of a session's start (18:00 before) and end (17:00)."""
    at = lambda minutes: F.to_utc_timestamp(F.timestamp_seconds(minutes * 60), zone)
    start = sday.cast("bigint") * DAY - SHIFT
    return utc_minutes(at(start)), utc_minutes(at(start + SESSION_END + 1))


def session_minute(clock: str) -> int:
    """'09:30' -> 930."""
    hours, minutes = map(int, clock.split(":"))
    return (hours * 60 + minutes + SHIFT) % DAY


def clock(sm: int) -> str:
    """930 -> '09:30'."""
    minutes = (sm - SHIFT) % DAY
    return f"{minutes // 60:02d}:{minutes % 60:02d}"


def contract_month(symbol: Column) -> Column:
    """3, 6, 9 or 12 by the month letter before the last character; 0 for others."""
    letter = F.substring(symbol, -2, 1)
    return F.when(letter == "H", 3).when(letter == "M", 6).when(letter == "U", 9).when(letter == "Z", 12).otherwise(0)


def in_roll_window(symbol: Column, date: Column) -> Column:
    """Whether the expiring contract is still held in its month, from the eighth day on."""
    return (contract_month(symbol) == F.month(date)) & (F.dayofmonth(date) >= 8)


def weekday(sday: Column) -> Column:
    """0 for Monday."""
    return F.pmod(sday + 3, F.lit(7)).cast("int")


def weekdays_left(date: Column) -> Column:
    """Monday-to-Friday days after ``date`` up to the month's end."""
    days = F.sequence(F.date_add(date, 1), F.date_add(F.last_day(date), 1))
    return F.size(F.filter(days, lambda d: (F.weekday(d) < 5) & (d <= F.last_day(date))))


def third_friday(date: Column) -> Column:
    first = F.trunc(date, "month")
    return F.date_add(first, F.pmod(F.lit(4) - F.weekday(first), F.lit(7)) + 14)
