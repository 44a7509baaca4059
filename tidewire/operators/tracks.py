"""What the tracks of a map say of a timetable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import map_view

RAILS_M = 30.0  # metres from a track up to which a stop is at it
AT_RAILS = 0.6  # share of its stops at tracks below which a route is a bus
CELL = 0.002  # degrees of a cell; the map reaches a place if a road has a node in its cell or one of the eight around
RAILS = ["rail", "subway", "cable"]  # the networks that have all kinds of railway between them


def reached(stops: DataFrame, nodes: DataFrame) -> DataFrame:
    """stops (lat, lon) that the roads' nodes (lat, lon) reach."""
    cell = lambda c: F.floor(F.col(c) / CELL)
    around = lambda c: F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])).alias(c)
    there = nodes.select(cell("lat").alias("_cy"), cell("lon").alias("_cx")).distinct()
    there = there.select(around("_cy"), "_cx").select("_cy", around("_cx")).distinct()
    return stops.withColumns({"_cy": cell("lat"), "_cx": cell("lon")}).join(there, ["_cy", "_cx"], "left_semi").drop("_cy", "_cx")


def kinds_from_tracks(calls: DataFrame, stops: DataFrame, nodes: DataFrame, tracks: DataFrame, route: str = "route") -> DataFrame:
    """(route, is_bus) of the routes of calls (route, stop_id), those that a timetable gives as trams or undergrounds: a bus if fewer than
    AT_RAILS of its stops (stop_id, lat, lon) that the roads' nodes (lat, lon) reach are within RAILS_M of a track (edge,
    lat1, lon1, lat2, lon2). Routes that the map does not reach are as given, and so are all if the map has no track."""
    asked = stops.join(calls.select("stop_id").distinct(), "stop_id", "left_semi")
    known = reached(asked, nodes)
    edges = tracks.select("edge", F.col("lon1").alias("x1"), F.col("lat1").alias("y1"), F.col("lon2").alias("x2"), F.col("lat2").alias("y2"))
    points = known.select(F.col("stop_id").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    at = map_view.snap(points, edges, RAILS_M, 1).select(F.col("id").alias("stop_id"), F.lit(1.0).alias("_at"))
    share = calls.select(route, "stop_id").distinct().join(known.select("stop_id"), "stop_id").join(at, "stop_id", "left")
    share = share.groupBy(route).agg(F.avg(F.coalesce("_at", F.lit(0.0))).alias("_share"))
    any_track = tracks.limit(1).agg((F.count(F.lit(1)) > 0).alias("any")).scalar()
    found = calls.select(route).distinct().join(share, route, "left")
    return found.select(route, (F.coalesce(F.col("_share") < AT_RAILS, F.lit(False)) & any_track).alias("is_bus"))
