"""Addresses of stations that are named alike: the town after the name, and numbers that stay from import to import."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import joins
from .tables import discard, materialise

KEPT_M = 300.0  # how far a station may have moved to keep its number


def with_towns(stations: DataFrame, towns: DataFrame) -> DataFrame:
    """stations (id, name, town_id, service, lat, lon) with address: the name, of those in another town than the busiest station of that name with the
    town after it, or its district where several of the name's towns are called alike. towns (town_id, town, district); stations without
    a town keep the name."""
    by = Window.partitionBy("name")
    busiest = F.struct((-F.col("service")).alias("a"), F.col("lat").alias("b"), F.col("lon").alias("c"), F.col("id").alias("d"))
    x = stations.join(towns.select("town_id", "town", "district"), "town_id", "left")
    x = x.withColumn("_home", F.min_by("town_id", busiest).over(by))
    alike = x.where("town IS NOT NULL").groupBy("name", "town").agg((F.count_distinct("town_id") > 1).alias("_alike"))
    x = x.join(alike, ["name", "town"], "left")
    after = F.when(F.col("_alike") & F.col("district").isNotNull(), F.col("district")).otherwise(F.col("town"))
    other = F.col("town").isNotNull() & ~F.col("town_id").eqNullSafe(F.col("_home"))
    return x.withColumn("address", F.when(other, F.concat_ws("-", "name", after)).otherwise(F.col("name"))).drop("_home", "_alike", "town", "district")


def nearest_first(pairs: DataFrame, left: str, right: str, order: list[Column]) -> DataFrame:
    """Of pairs those that are taken when the first in order goes first and each side is used once. A round takes, everywhere at once, the pairs that are
    first for both of their sides, which no earlier one can touch, and drops what they use: so no group is a task of its own."""
    rank = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], F.col(left).alias("_l"), F.col(right).alias("_r"))
    now, taken = materialise(pairs.withColumn("_rank", rank), "pairs"), None
    while True:
        first = [F.min("_rank").over(Window.partitionBy(side)) for side in (left, right)]
        seen = Observation()
        best = now.withColumn("_both", (F.col("_rank") == first[0]) & (F.col("_rank") == first[1])).where("_both").drop("_both")
        best = materialise(best.observe(seen, F.count(F.lit(1)).alias("n")), "taken")
        if not seen.get["n"]:
            return (best if taken is None else taken).drop("_rank")
        taken = best if taken is None else taken.unionByName(best)
        old, now = now, materialise(now.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"), "pairs")
        discard(old)


def _places(rows: DataFrame, at: list[str], key: str, order: list[str], apart: list) -> tuple[DataFrame, DataFrame]:
    """(members, places) of rows (key, at): rows of one place, and of one value of apart, are one place with its smallest key as _p, its _n members numbered by
    order as _i."""
    by = Window.partitionBy(*at, *apart)
    members = rows.withColumns({"_p": F.min(key).over(by), "_n": F.count(F.lit(1)).over(by), "_i": F.row_number().over(by.orderBy(*order))})
    members = materialise(members, "members")
    places = members.where("_i = 1").select("_p", *at, "_n", F.lit(0).cast("long").alias("_off"), F.col(order[0]).alias("_head"))
    return members, materialise(places, "places")


def _used(places: DataFrame, best: DataFrame, key: str, members: DataFrame, order: str) -> DataFrame:
    """places after the pairs of best took their first _t members: those with members left, _head being the next one."""
    gone = best.select(F.col(key).alias("_p"), "_t")
    left = places.join(gone, "_p", "left").withColumn("_off", F.col("_off") + F.coalesce("_t", F.lit(0))).where("_off < _n")
    moved = left.where("_t IS NOT NULL").drop("_head", "_t").join(members.select("_p", (F.col("_i") - 1).cast("long").alias("_off"), F.col(order).alias("_head")).distinct(), ["_p", "_off"])
    return materialise(left.where("_t IS NULL").drop("_t").unionByName(moved), "places")


def nearest_kept(stations: DataFrame, kept: DataFrame) -> DataFrame:
    """(id, _e, number): what nearest_first gives over all pairs of stations (id, name, lat, lon) and kept (_e, name, _lat, _lon, number) of one name within
    KEPT_M, ordered by metres, number, id, without making all pairs.

    Pairs are made in rings, nearest first, of what the rings before left over, and between places rather than rows: of two places that have no other pair as
    near, all members pair at once in order. Where pairs are equally far, a round takes one."""
    kept = kept.select("name", "_lat", "_lon", "number", "_e").distinct()
    again = F.when(F.count(F.lit(1)).over(Window.partitionBy("_e")) > 1, F.col("_e"))  # a number with several places is used once
    s_rows, s = _places(stations.select("id", "name", "lat", "lon"), ["name", "lat", "lon"], "id", ["id"], [])
    k_rows, k = _places(kept.withColumn("_again", again), ["name", "_lat", "_lon"], "_e", ["number", "_e"], ["_again"])
    taken, inner = [], -1.0
    for outer in (KEPT_M / 64, KEPT_M / 16, KEPT_M / 4, KEPT_M):
        near = joins.within(s.select(F.col("_p").alias("_s"), "name", "lat", "lon"), k.select(F.col("_p").alias("_k"), "name", "_lat", "_lon"), outer, ("lat", "lon"), ("_lat", "_lon"), ["name"])
        now = materialise(near.where(F.col("metres") > inner).select("_s", "_k", F.col("metres").alias("away")), "pairs")
        inner = outer
        while True:
            left = s.select(F.col("_p").alias("_s"), (F.col("_n") - F.col("_off")).alias("_sn"), F.col("_off").alias("_so"), F.col("_head").alias("_sh"))
            right = k.select(F.col("_p").alias("_k"), (F.col("_n") - F.col("_off")).alias("_kn"), F.col("_off").alias("_ko"), F.col("_head").alias("_kh")).distinct()
            x = now.join(left, "_s").join(right, "_k").withColumn("_rank", F.struct("away", "_kh", "_sh", "_s", "_k"))
            both, alone = [], []
            for side in ("_s", "_k"):
                by = Window.partitionBy(side)
                x = x.withColumns({f"{side}_first": F.min("_rank").over(by), f"{side}_away": F.min("away").over(by)})
                x = x.withColumn(f"{side}_as_near", F.count_if(F.col("away") == F.col(f"{side}_away")).over(by))
                both.append(F.col("_rank") == F.col(f"{side}_first"))
                alone.append(F.col(f"{side}_as_near") == 1)
            t = F.when(alone[0] & alone[1], F.least("_sn", "_kn")).otherwise(F.lit(1)).cast("long")
            seen = Observation()
            x = x.select("_s", "_k", "away", "_so", "_ko", (both[0] & both[1]).alias("_both"), t.alias("_t"))
            x = materialise(x.observe(seen, F.count_if("_both").alias("n")), "pairs")
            discard(now)
            now = x.select("_s", "_k", "away")
            if not seen.get["n"]:
                break
            best = materialise(x.where("_both").select("_s", "_k", "_so", "_ko", "_t").dropDuplicates(["_s", "_k"]), "taken")
            taken.append(best)
            old_s, old_k = s, k
            s, k = _used(s, best, "_s", s_rows, "id"), _used(k, best, "_k", k_rows, "number")
            discard(old_s, old_k)
        discard(now)
    if not taken:
        return stations.join(kept.select("_e", "number").limit(0)).select("id", "_e", "number")
    each = functools.reduce(DataFrame.unionByName, taken).withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), "_t")))
    each = each.select("_s", "_k", (F.col("_so") + F.col("_j")).alias("_si"), (F.col("_ko") + F.col("_j")).alias("_ki"))
    each = each.join(s_rows.select(F.col("_p").alias("_s"), F.col("_i").cast("long").alias("_si"), "id"), ["_s", "_si"])
    numbers = k_rows.select(F.col("_p").alias("_k"), F.col("_i").cast("long").alias("_ki"), "_e", "number").distinct()
    return each.join(numbers, ["_k", "_ki"]).select("id", "_e", "number")


def numbered(stations: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbers, entries) of stations (id, name, service, lat, lon), name being the address, and kept (name, lat, lon, number) of the imports before.

    A station within KEPT_M of a kept place of its name has that place's number, nearest pairs first. The others have numbers that none of the name had: the
    busiest first where none was kept, the rest from the south, or from the west where they lie further apart that way. A station alone of its
    name, with none kept, has number 0. numbers: (id, name, number). entries: what the next import is given, places that are not used kept as they are, so
    that a stop which comes back gets its own number again."""
    kept = materialise(kept.select("name", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), "number").withColumn("_e", F.xxhash64("name", "number")), "kept")
    matched = materialise(nearest_kept(stations, kept), "matched")
    top = kept.groupBy("name").agg(F.max("number").alias("_top"))
    size = stations.groupBy("name").agg(F.count(F.lit(1)).alias("_size"))
    fresh = stations.join(matched.select("id"), "id", "left_anti").join(size, "name").join(top, "name", "left").where("_size > 1 OR _top IS NOT NULL")
    busiest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("service"), "lat", "lon", "id"))
    fresh = fresh.withColumn("_first", F.col("_top").isNull() & (busiest == 1))
    rest = Window.partitionBy("name", "_first")
    high, wide = F.max("lat").over(rest) - F.min("lat").over(rest), F.max("lon").over(rest) - F.min("lon").over(rest)
    along = high >= wide * F.cos(F.radians((F.max("lat").over(rest) + F.min("lat").over(rest)) / 2))
    fresh = fresh.withColumn("_at", F.when(along, F.col("lat")).otherwise(F.col("lon")))
    order = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("_first"), "_at", "id"))
    new = fresh.select("id", (F.coalesce("_top", F.lit(0)) + order).cast("int").alias("number"))
    every = new.unionByName(matched.select("id", F.col("number").cast("int").alias("number")))
    numbers = stations.join(every, "id", "left").select("id", "name", F.coalesce("number", F.lit(0)).alias("number"))
    numbers = materialise(numbers, "numbers")
    here = numbers.where("number > 0").join(stations.select("id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")), "id").select("name", "lat", "lon", "number")
    unused = kept.join(matched.select("_e"), "_e", "left_anti").select("name", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("number").cast("int").alias("number"))
    return numbers, here.unionByName(unused)
