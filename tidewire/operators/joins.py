"""Joins that a timetable needs and SQL has no single word for. Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .tables import discard, materialise


def keep_groups_touching(rows: DataFrame, group: str, member: DataFrame, on: str) -> DataFrame:
    """Whole groups of which any row's key is in member (a group-level ANY, so the groups found are semi-joined back)."""
    hit = rows.join(member.select(on).distinct(), on, "left_semi").select(group).distinct()
    return rows.join(hit, group, "left_semi")


def semi_chain(first: DataFrame, *steps: tuple[DataFrame, str]) -> DataFrame:
    """first reduced by each (frame, key) in turn, every frame reduced by the ones after it."""
    out = None
    for frame, key in reversed(steps):
        kept = frame if out is None else frame.join(out[0].select(out[1]).distinct(), out[1], "left_semi")
        out = (kept, key)
    return first if out is None else first.join(out[0].select(out[1]).distinct(), out[1], "left_semi")


def parent_closure(rows: DataFrame, key: str, parent: str, wanted: DataFrame) -> DataFrame:
    """The keys of wanted and all their ancestors. One anti join a level; trees of stops are two or three deep."""
    found = materialise(wanted.select(key).distinct(), "closure")
    front = found
    while True:
        up = rows.join(front, key, "left_semi").where(F.col(parent).isNotNull()).select(F.col(parent).alias(key)).distinct()
        front = materialise(up.join(found, key, "left_anti"), "closure")
        if front.isEmpty():
            return found
        old, found = found, materialise(found.unionByName(front), "closure")
        discard(old)


def stab(spans: DataFrame, start: str, end: str, instants: DataFrame, at: str, before: int = 0, after: int = 0, width: int = 3600) -> DataFrame:
    """Pairs with start - before <= at <= end + after. Both sides are cut into buckets of width, so this is an
    equi-join on the bucket; a span is repeated once a bucket it covers."""
    lo, hi = F.col(start) - before, F.col(end) + after
    cut = spans.withColumn("_b", F.explode(F.sequence(F.floor(lo / width), F.greatest(F.floor(lo / width), F.floor(hi / width)))))
    return cut.join(instants.withColumn("_b", F.floor(F.col(at) / width)), "_b").where(F.col(at).between(lo, hi)).drop("_b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """left with the values of the last right row per keys whose since <= at: one sort of the union, no range join."""
    tie = F.lit(0).alias("_t")
    named = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_t"), F.struct(*named).alias("_l"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("_r"))
    r = right.select(*keys, F.col(since).alias("_at"), tie, F.lit(None).cast(left.select(F.struct(*named).alias("v")).schema["v"].dataType).alias("_l"), F.struct(*values).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_at", "_t").rowsBetween(Window.unboundedPreceding, 0)
    out = l.unionByName(r).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_t = 1")
    return out.select(*keys, "_l.*", "_r.*")


def reject_mismatched(updates: DataFrame, plan: DataFrame, group: str, keys: list[str], value: str) -> DataFrame:
    """updates without the groups in which a matched row's value differs from the plan's (one wrong row rejects the group)."""
    wrong = updates.alias("u").join(plan.alias("p"), [group, *keys]).where(F.col(f"u.{value}") != F.col(f"p.{value}")).select(group).distinct()
    return updates.join(wrong, group, "left_anti")


def cells(lat: Column, lon: Column, size: float) -> list[Column]:
    return [F.floor(lat / size).alias("_cy"), F.floor(lon / size).alias("_cx")]


def within(left: DataFrame, right: DataFrame, radius_m: float, left_at: tuple[str, str], right_at: tuple[str, str], on: list[str] | None = None) -> DataFrame:
    """Pairs of places at most radius_m apart, with metres. Right places stand in their grid cell, left ones ask their own and the
    eight around; a cell is as high as the radius and, at up to 70 degrees of latitude, as wide."""
    high = radius_m / geo.METRES_PER_DEGREE
    wide = high / 0.342  # the cosine of 70 degrees
    ly, lx, ry, rx = F.col(left_at[0]), F.col(left_at[1]), F.col(right_at[0]), F.col(right_at[1])
    around = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    asked = left.withColumn("_d", F.explode(around)).withColumns({"_cy": F.floor(ly / high) + F.col("_d.dy"), "_cx": F.floor(lx / wide) + F.col("_d.dx")}).drop("_d")
    there = right.withColumns({"_cy": F.floor(ry / high), "_cx": F.floor(rx / wide)})
    pairs = asked.join(there, ["_cy", "_cx", *(on or [])])
    return pairs.withColumn("metres", geo.metres(ly, lx, ry, rx)).where(F.col("metres") <= radius_m).drop("_cy", "_cx")


def nearest(pairs: DataFrame, key: str, candidate: str) -> DataFrame:
    """The nearest candidate per key of within()'s pairs, ties (to the millimetre) to the smaller candidate."""
    return pairs.groupBy(key).agg(F.min_by(candidate, F.struct(F.round("metres", 3), candidate)).alias(candidate), F.min("metres").alias("metres"))


def shared_ways(hops: DataFrame, trips: DataFrame, dates: DataFrame) -> DataFrame:
    """Groups of trips that travel a hop at the same times in the same mode on a common day:
    (mode, from_id, to_id, from_dep, to_arr, trips)."""
    by = ["mode", "from_id", "to_id", "from_dep", "to_arr"]
    run = hops.join(trips.select("trip_id", "mode"), "trip_id").join(dates, "trip_id")
    day = run.groupBy(*by, "service_date").agg(F.array_sort(F.collect_set("trip_id")).alias("trips")).where(F.size("trips") > 1)
    return day.select(*by, "trips").distinct()


def point_in_polygon(points: DataFrame, at: tuple[str, str], key: str, edges: DataFrame, area: str, size: float = 0.05) -> DataFrame:
    """(key, area) of points inside areas given as unordered border edges (lat1, lon1, lat2, lon2): odd crossings of the ray to the
    east. Points and edges meet by latitude band, so an edge is repeated once a band it crosses."""
    y, x = F.col(at[0]), F.col(at[1])
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    bands = edges.withColumn("_b", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))
    met = points.withColumn("_b", F.floor(y / size)).join(bands, "_b")
    crossing = (low <= y) & (y < high) & (x < F.col("lon1") + (y - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) * (F.col("lon2") - F.col("lon1")))
    return met.where(crossing).groupBy(key, area).agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select(key, area)


def greedy_match(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """One-to-one pairs within groups (left_id, right_id by lat/lon), nearest pairs first, each side used once. Greedy matching is a
    sequence of choices; groups (stops of one name in one town) are small."""
    import pandas as pd

    both = left.select(group, F.lit(True).alias("is_left"), F.col("left_id").alias("id"), "lat", "lon").unionByName(
        right.select(group, F.lit(False).alias("is_left"), F.col("right_id").alias("id"), "lat", "lon"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        a, b = rows[rows["is_left"]].sort_values("id"), rows[~rows["is_left"]].sort_values("id")
        if a.empty or b.empty:
            return pd.DataFrame({group: [], "left_id": [], "right_id": []}).astype({"left_id": "int64", "right_id": "int64"})
        d = np.hypot((b["lon"].to_numpy()[None] - a["lon"].to_numpy()[:, None]) * np.cos(np.radians(a["lat"].to_numpy()))[:, None], b["lat"].to_numpy()[None] - a["lat"].to_numpy()[:, None])
        used_a, used_b, out = set(), set(), []
        for i, j in zip(*np.unravel_index(np.argsort(d, axis=None, kind="stable"), d.shape), strict=True):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((rows[group].iloc[0], int(a["id"].iloc[i]), int(b["id"].iloc[j])))
        return pd.DataFrame(out, columns=[group, "left_id", "right_id"])

    kind = dict(left.dtypes)[group]
    return both.groupBy(group).applyInPandas(run, f"`{group}` {kind}, left_id long, right_id long")
