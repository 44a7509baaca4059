"""Delays as Column expressions. A delay is in seconds; null is unknown, 0 is on time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import half_up

MOST_PLAUSIBLE_S = 21_600
GONE_S = 30
# fixed values: seconds from which a delay is early, minor, major, severe
EARLY_S, MINOR_S, MAJOR_S, SEVERE_S = -60, 120, 300, 600


def plausible(delay: Column) -> Column:
    return F.when(F.abs(delay) <= MOST_PLAUSIBLE_S, delay)


def event_delay(time: Column, delay: Column, scheduled: Column) -> Column:
    """A reported time counts before a reported delay; what is too far off is unknown."""
    return plausible(F.coalesce(time - scheduled, delay))


def is_active(periods: Column, now: Column) -> Column:
    """Whether now is in one of the periods (start <= now < end, 0 open); none: always."""
    return (F.size(periods) == 0) | F.exists(periods, lambda p: ((p["start"] == 0) | (p["start"] <= now)) & ((p["end"] == 0) | (now < p["end"])))


def minutes(delay: Column) -> Column:
    return half_up(delay / 60) * 60


def delay_class(delay: Column) -> Column:
    d = minutes(delay)
    return (
        F.when(delay.isNull(), "none").when(d <= EARLY_S, "early").when(d >= SEVERE_S, "severe").when(d >= MAJOR_S, "major")
        .when(d >= MINOR_S, "minor").otherwise("ok")
    )


def leaves_at(planned: Column, delay: Column) -> Column:
    return planned + minutes(F.coalesce(delay, F.lit(0)))


def left_already(planned: Column, delay: Column, now: Column) -> Column:
    return leaves_at(planned, delay) < now - GONE_S


def until_minutes(leaves: Column, now: Column) -> Column:
    return F.floor(leaves / 60) - F.floor(now / 60)
