"""Set operations of calendars, extracts and boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .topk import first_rows

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


def service_dates(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, date) of weekly patterns within their ranges, dates added (1) and removed (2); of several exceptions for one
    date the last in file order (column line) counts."""
    day = F.explode(F.sequence("start_date", "end_date")).alias("date")
    weekly = calendar.select("service_id", F.array(*DAYS).alias("_d"), day).where(F.get("_d", F.weekday("date")) == 1).select("service_id", "date")
    last = exceptions.groupBy("service_id", "date").agg(F.max_by("exception_type", "line").alias("kind"))
    kept = weekly.join(last.where("kind = 2"), ["service_id", "date"], "left_anti")
    return kept.unionByName(last.where("kind = 1").select("service_id", "date")).distinct()


def first_wins(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """The union, of rows of one key that of the first frame that has it."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_p", F.lit(i))
        out = f if out is None else out.unionByName(f)
    w = Window.partitionBy(*key).orderBy("_p")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def last_wins(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """One row a key, that of the highest version."""
    values = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), version).alias("_v")).select(*key, "_v.*")


def days_around(rows: DataFrame, date: str, before: int = 1, after: int = 1) -> DataFrame:
    return rows.withColumn(date, F.explode(F.sequence(F.date_sub(date, before), F.date_add(date, after))))


def any_common(left: Column, right: Column) -> Column:
    return F.arrays_overlap(left, right)


def held_board(answer: DataFrame, reserve: DataFrame, group: list[str], keys: list[str], leaves: str, now: int, limit: int) -> DataFrame:
    """Of each group the answer's rows and those of the reserve that it lacks, still to leave: the first limit of them."""
    extra = reserve.join(answer.select(*group, *keys), [*group, *keys], "left_anti").withColumn("held", F.lit(True))
    both = answer.withColumn("held", F.lit(False)).unionByName(extra)
    return first_rows(both.where(F.col(leaves) >= now - 30), group, [leaves, *keys], limit)
