"""Aggregations with the tie rules of a timetable."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import half_up


def agreed(rows: DataFrame, group: list[str], delay: str, reported: str) -> DataFrame:
    """(group, agreed): the delay most rows have, the larger of equals; rows that report one of their own count before those
    that carry one on; null where none is known."""
    n = rows.groupBy(*group, delay).agg(
        F.count_if(F.col(reported) & F.col(delay).isNotNull()).alias("own"), F.count(delay).alias("all"))
    top = n.groupBy(*group).agg(
        F.sum("own").alias("_o"),
        F.max_by(delay, F.when(F.col("own") > 0, F.struct("own", delay))).alias("_own"),
        F.max_by(delay, F.when(F.col("all") > 0, F.struct("all", delay))).alias("_all"))
    return top.select(*group, F.when(F.col("_o") > 0, F.col("_own")).otherwise(F.col("_all")).alias("agreed"))


def upper_median(value: str) -> Column:
    """The middle value of an expression, the upper of two: the lower one of its negatives. An aggregate keeps distinct values with
    their counts, and parts of a group are aggregated where they lie."""
    return F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -({value}))")


def minutes_median(value: str) -> Column:
    return half_up(upper_median(value) / 60)


def calls_per_stop(members: DataFrame, book: DataFrame) -> DataFrame:
    """(stop_id, calls) from a dictionary of stop lists: members are counted by list before the lists are exploded."""
    n = members.groupBy("id").count()
    return book.join(n, "id").select("count", F.explode("list").alias("s")).groupBy(F.col("s.stop_id").alias("stop_id")).agg(F.sum("count").alias("calls"))


def top_values(rows: DataFrame, group: list[str], value: str, k: int) -> DataFrame:
    """(group, value, n, place): the k most frequent values, ties by value."""
    n = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), value))
    return n.withColumn("place", rank).where(F.col("place") <= k)


def centroid(rows: DataFrame, group: list[str], lat: str, lon: str, weight: Column) -> DataFrame:
    w = F.sum(weight)
    return rows.groupBy(*group).agg((F.sum(F.col(lat) * weight) / w).alias("lat"), (F.sum(F.col(lon) * weight) / w).alias("lon"), w.alias("weight"))


def busiest(rows: DataFrame, group: list[str], value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value, ties to the smallest order."""
    n = rows.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_o"))
    return n.groupBy(*group).agg(F.max_by(value, F.struct("n", -F.col("_o"))).alias(value), F.max("n").alias("n"))


def merge_near(middles: DataFrame, group: str, metres: float = 25.0) -> DataFrame:
    """(group, place, lat, lon, modes) of (group, mode, lat, lon, weight): modes join the first place, busiest first, that is near.
    A choice depends on those before; a group holds the nine modes at most."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import math

        places: list[list] = []
        for _, r in rows.sort_values(["weight", "mode"], ascending=[False, True]).iterrows():
            for p in places:
                if math.hypot((p[1] - r["lon"]) * math.cos(math.radians((p[0] + r["lat"]) / 2)), p[0] - r["lat"]) * 111_320 <= metres:
                    p[2].append(r["mode"])
                    break
            else:
                places.append([r["lat"], r["lon"], [r["mode"]]])
        return pd.DataFrame([(rows[group].iloc[0], i, p[0], p[1], sorted(p[2])) for i, p in enumerate(places)], columns=[group, "place", "lat", "lon", "modes"])

    return middles.groupBy(group).applyInPandas(run, f"`{group}` {dict(middles.dtypes)[group]}, place int, lat double, lon double, modes array<string>")


def sliding_peak(rows: DataFrame, at: str, width: int, step: int) -> DataFrame:
    """(start, n) of the busiest window of width seconds, windows starting every step; the earliest of equals."""
    starts = F.sequence(F.floor((F.col(at) - width) / step) * step + step, F.floor(F.col(at) / step) * step, F.lit(step))
    n = rows.select(F.explode(starts).alias("start")).groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.desc("n"), "start").limit(1)
