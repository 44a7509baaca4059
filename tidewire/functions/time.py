"""Service days and clocks as Column expressions. A service day begins twelve hours before noon of its date in its zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"


def _epoch(utc: Column) -> Column:
    """Seconds of a timestamp without zone that is read as UTC, whatever the session's zone."""
    start = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_diff("SECOND", start, utc.cast("timestamp_ntz"))


def service_day_start(day: Column, zone: str = ZONE) -> Column:
    noon = day.cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")
    return _epoch(F.convert_timezone(F.lit(zone), F.lit("UTC"), noon)) - 43_200


def _local(epoch: Column, zone: str) -> Column:
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), epoch)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_date(epoch: Column, zone: str = ZONE) -> Column:
    return _local(epoch, zone).cast("date")


def local_clock(epoch: Column, zone: str = ZONE) -> Column:
    return F.date_format(_local(epoch, zone), "HHmm")


def parse_time(c: Column) -> Column:
    """H:MM:SS to seconds, hours beyond 24 allowed; null for an empty or broken text."""
    p = F.split(c, ":")
    part = [F.get(p, F.lit(i)).try_cast("int") for i in range(3)]
    return F.when(c.rlike(r"^\d+:\d\d:\d\d$"), part[0] * 3600 + part[1] * 60 + part[2])


def add_days(day: Column, n: int | Column) -> Column:
    return F.date_add(day, n)


def weekday(day: Column) -> Column:
    """0 for Monday."""
    return F.weekday(day)


def day_of(now: Column, today: Column, yesterday_end: Column) -> Column:
    """The service day that counts at now: yesterday while its last departure (epoch seconds) is to come."""
    return F.when(yesterday_end >= now, F.date_sub(today, 1)).otherwise(today)
