"""The way of every hop between two stops: kept from before, routed on the network, or straight."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, paths
from . import routing
from .tables import materialise

HOP = ["net", "from_id", "to_id"]
POINTS = "array<struct<lat:double,lon:double,share:double>>"


def build(
    hops: DataFrame, stops: DataFrame, nodes: DataFrame, edges: DataFrame, kept: DataFrame | None = None, detour: tuple[float, float] = (2.0, 1500.0), radius_m: float = 250.0,
    penalty: float = 2.0, far_m: float = 10_000.0, near_m: float = 3_000.0, max_turn: float | None = None,
) -> DataFrame:
    """(net, from_id, to_id, state, points) of the distinct hops (net, from_id, to_id) between stops (stop_id, lat, lon).

    state says where points, an array of (lat, lon, share of the hop's time), comes from. kept: the hop is in kept (net, from_id, to_id, points), and is not routed again; null
    points there say that no way was found, and it stays straight. routed: the cheapest way on its net's edges (edge, net, a, b, cost, direction, main,
    speed) between nodes (id, lat, lon), of at most detour[0] times the straight line and detour[1] metres more; hops of more than far_m metres go by main
    edges, and by others only within near_m of their stops. straight: no such way, or kept so.

    All hops of a net are routed at once (see routing.routes). A net has a name of its own and there are a few, so nets follow each other."""
    hops = hops.select(*HOP).distinct()
    if kept is not None:
        known = hops.join(kept.select(*HOP, "points"), HOP).select(*HOP, F.when(F.col("points").isNull(), "straight").otherwise("kept").alias("state"), F.col("points").cast(POINTS).alias("points"))
        fresh = hops.join(kept.select(*HOP), HOP, "left_anti")
    else:
        known, fresh = None, hops
    at = stops.select("stop_id", "lat", "lon")
    for end, c in (("from_id", "1"), ("to_id", "2")):
        fresh = fresh.join(at.select(F.col("stop_id").alias(end), F.col("lat").alias(f"y{c}"), F.col("lon").alias(f"x{c}")), end)
    fresh = materialise(fresh.withColumn("metres", geo.metres(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))).withColumn("hop", F.xxhash64(*HOP)), "fresh")
    found = [_routed(fresh.where(F.col("net") == net), stops, nodes, edges.where(F.col("net") == net).drop("net"), detour, radius_m, penalty, far_m, near_m, max_turn)
             for net in sorted(r[0] for r in edges.select("net").distinct().collect())]
    routed = materialise(functools.reduce(DataFrame.unionByName, found), "routed") if found else fresh.where("false").select("hop", F.lit(None).cast(POINTS).alias("points"))
    fresh = fresh.join(routed, "hop", "left").select(*HOP, F.when(F.col("points").isNull(), "straight").otherwise("routed").alias("state"), "points")
    every = fresh if known is None else fresh.unionByName(known)
    for end, c in (("from_id", "1"), ("to_id", "2")):
        every = every.join(at.select(F.col("stop_id").alias(end), F.col("lat").alias(f"y{c}"), F.col("lon").alias(f"x{c}")), end)
    line = F.array(*[F.struct(F.col(f"y{c}").alias("lat"), F.col(f"x{c}").alias("lon"), F.lit(share).alias("share")) for c, share in (("1", 0.0), ("2", 1.0))])
    return every.select(*HOP, "state", F.coalesce("points", line.cast(POINTS)).alias("points"))


def _routed(hops: DataFrame, stops: DataFrame, nodes: DataFrame, edges: DataFrame, detour, radius_m, penalty, far_m, near_m, max_turn) -> DataFrame:
    """(hop, points) of the hops of one net that have a way."""
    used = hops.select(F.explode(F.array("from_id", "to_id")).alias("stop_id")).distinct()
    at = stops.join(used, "stop_id", "left_semi").select(F.col("stop_id").alias("stop"), "lat", "lon")
    ends = materialise(routing.candidates(at, nodes, edges.select("edge", "a", "b"), radius_m, penalty), "ends")
    ways = materialise(routing.arcs(nodes, edges), "ways")
    asked = hops.select("hop", F.col("from_id").alias("source"), F.col("to_id").alias("target"), (F.col("metres") * detour[0] + detour[1]).alias("most"), (F.col("metres") > far_m).alias("far"))
    found = routing.routes(asked, ends, ways, max_turn, stops=at, near_m=near_m).where("reaches").select("hop", "path", F.size("path").alias("n"))
    steps = found.select("hop", "n", F.posexplode("path").alias("i", "arc")).join(ways.select("arc", "edge", "lat1", "lon1", "lat2", "lon2", "speed"), "arc")
    place = ends.select(F.col("stop"), "edge", "t")
    back = F.col("arc") != F.col("edge") * 2
    steps = steps.join(asked.select("hop", "source", "target"), "hop")
    for end, c in (("source", "t1"), ("target", "t2")):  # how far along its arc, in its direction, a stop's place is
        steps = steps.join(place.select(F.col("stop").alias(end), "edge", F.col("t").alias(c)), [end, "edge"], "left").withColumn(c, F.when(back, 1 - F.col(c)).otherwise(F.col(c)))
    along = lambda t, c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * t
    last = F.col("i") == F.col("n") - 1
    ends_at = [F.when(last, along(F.col("t2"), c)).otherwise(F.col(f"{c}2")).alias(c) for c in ("lat", "lon")]
    points = steps.select("hop", (F.col("i") + 1).alias("pos"), *ends_at, F.col("speed").cast("double").alias("speed"))
    points = points.unionByName(steps.where("i = 0").select("hop", F.lit(0).alias("pos"), along(F.col("t1"), "lat").alias("lat"), along(F.col("t1"), "lon").alias("lon"), F.lit(None).cast("double").alias("speed")))
    timed = paths.time_shares(points, ["hop"], "pos", "speed")
    item = F.struct("pos", "lat", "lon", "share")
    return timed.groupBy("hop").agg(F.array_sort(F.collect_list(item)).alias("p")).select("hop", F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), x["share"].cast("double").alias("share"))).alias("points"))


def metres_of(points: Column) -> Column:
    """The length of a hop's points."""
    steps = F.transform(F.sequence(F.lit(2), F.size(points)), lambda i: F.struct(F.get(points, i - 2).alias("p"), F.get(points, i - 1).alias("q")))
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + geo.metres(x["p"]["lat"], x["p"]["lon"], x["q"]["lat"], x["q"]["lon"]))
