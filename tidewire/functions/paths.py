"""Polylines: length, simplification, time shares, cut steps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import geo


def lengths(points: DataFrame, group: list[str], pos: str) -> DataFrame:
    """points with step (metres from the point before) and along (metres from the start)."""
    w = Window.partitionBy(*group).orderBy(pos)
    step = geo.metres(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    out = points.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return out.withColumn("along", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def time_shares(points: DataFrame, group: list[str], pos: str, speed: str) -> DataFrame:
    """points with share (0 to 1 of the way's time): a step takes its length by its speed, a missing speed is the one before, else
    the one after, else the same for all."""
    w = Window.partitionBy(*group).orderBy(pos)
    before = F.last(speed, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(speed, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = lengths(points, group, pos).withColumn("_t", F.col("step") / F.coalesce(before, after, F.lit(1.0)))
    run, total = F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_t").over(Window.partitionBy(*group))
    return x.withColumn("share", F.when(total > 0, run / total).otherwise(F.lit(0.0))).drop("_t")


def cut_steps(points: DataFrame, group: list[str], pos: str, value: str, most: int) -> DataFrame:
    """Points of whole numbers with steps longer than most cut into equal rounded pieces."""
    w = Window.partitionBy(*group).orderBy(pos)
    x = points.withColumn("_p", F.lag(value).over(w))
    n = F.greatest(F.lit(1), F.ceil(F.abs(F.col(value) - F.coalesce("_p", value)) / most)).cast("int")
    x = x.withColumn("_n", n).withColumn("piece", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    between = geo.half_up(F.col("_p") + (F.col(value) - F.col("_p")) * F.col("piece") / F.col("_n"))
    return x.withColumn(value, F.when(F.col("_p").isNull() | (F.col("piece") == F.col("_n")), F.col(value)).otherwise(between)).drop("_p", "_n")


def kept_points(lat: list[float], lon: list[float], tolerance: float) -> list[int]:
    """Indexes of the points that a line within tolerance metres of all needs, the ends included."""
    import math

    keep, todo = {0, len(lat) - 1}, [(0, len(lat) - 1)]
    k = math.cos(math.radians(lat[0])) if lat else 1.0
    while todo:
        a, b = todo.pop()
        ex, ey = (lon[b] - lon[a]) * k, lat[b] - lat[a]
        size, far, at = ex * ex + ey * ey, -1.0, -1
        for i in range(a + 1, b):
            px, py = (lon[i] - lon[a]) * k, lat[i] - lat[a]
            t = min(1.0, max(0.0, (px * ex + py * ey) / size)) if size else 0.0
            d = round(math.hypot(px - t * ex, py - t * ey) * geo.METRES_PER_DEGREE, 6)  # equals to the micrometre are ties
            if d > far:
                far, at = d, i
        if far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return sorted(keep)


def simplified(lat: Column, lon: Column, tolerance: float = 1.5) -> Column:
    """The indexes kept of arrays of places; each split depends on the one before."""

    @F.pandas_udf("array<int>")
    def run(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series([kept_points(list(a), list(b), tolerance) if len(a) else [] for a, b in zip(lat, lon, strict=True)])

    return run(lat, lon)
