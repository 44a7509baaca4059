"""Boards and picks: top-k with rules of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .tables import materialise


SALTS = 16  # parts of a group that are cut to what may be on its board before they meet


def board(rows: DataFrame, group: list[str], order: list[str], in_window: str, limit: int = 40, least: int = 10) -> DataFrame:
    """Per group the first limit rows inside the window; where these are fewer than least, the first least rows of all. Parts of a
    group are cut to limit and least rows first, so the rows of the busiest group are never sorted in one task."""
    inside = F.col(in_window)
    upto = lambda w: F.sum(inside.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    part = Window.partitionBy(*group, "_s").orderBy(*order)
    x = rows.withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(SALTS))).withColumns({"_w": upto(part), "_a": F.row_number().over(part)})
    x = x.where((inside & (F.col("_w") <= limit)) | (F.col("_a") <= least)).drop("_s")
    by = Window.partitionBy(*group)
    x = x.withColumns({"_w": upto(by.orderBy(*order)), "_a": F.row_number().over(by.orderBy(*order)), "_n": F.sum(inside.cast("int")).over(by)})
    enough = F.least(F.col("_n"), F.lit(limit)) >= least
    return x.where((enough & inside & (F.col("_w") <= limit)) | (~enough & (F.col("_a") <= least))).drop("_w", "_a", "_n")


def first_rows(rows: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts groups to k rows before they are shuffled."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") <= k).drop("_n")


def merged_board(rows: DataFrame, source: str, leaves: str, least: int, order: list[str]) -> DataFrame:
    """Boards of several stops as one, cut where the first full board ends (boards of fewer than least rows reach as far as asked)."""
    ends = rows.groupBy(source).agg(F.max(leaves).alias("e"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).agg(F.min("e").alias("_cut"))
    return rows.crossJoin(F.broadcast(ends)).where(F.col("_cut").isNull() | (F.col(leaves) <= F.col("_cut"))).drop("_cut").orderBy(leaves, *order)  # one row


def picks(places: DataFrame, key: str, score: str, lat: str, lon: str, apart_m: float, most: int = 5) -> DataFrame:
    """At most most places, the highest score first, each at least apart_m from those before: a round picks one place (a top-1) and
    drops what is near it, so there are most rounds whatever the size."""
    left, out = places.select(key, score, lat, lon), None
    for place in range(most):
        best = materialise(left.orderBy(F.desc(score), key).limit(1).withColumn("place", F.lit(place)), "pick")
        out = best if out is None else out.unionByName(best)
        b = best.select(F.col(lat).alias("_y"), F.col(lon).alias("_x"))
        left = left.crossJoin(F.broadcast(b)).where(geo.metres(F.col(lat), F.col(lon), F.col("_y"), F.col("_x")) >= apart_m).select(key, score, lat, lon)  # one row
    return out
