"""Towns among the administrative areas of a map, and the town of every station."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import joins

LEVELS = (8, 6, 4)  # fixed values: municipalities, districts, states


def whole(edges: DataFrame) -> DataFrame:
    """Edges (area, lat1, lon1, lat2, lon2) of the areas whose border closes: every point of it is an end of an even number of edges."""
    ends = edges.select("area", F.explode(F.array(F.struct(F.col("lat1").alias("y"), F.col("lon1").alias("x")), F.struct(F.col("lat2").alias("y"), F.col("lon2").alias("x")))).alias("p"))
    odd = ends.groupBy("area", "p").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("area").distinct()
    return edges.join(odd, "area", "left_anti")


def points_inside(edges: DataFrame) -> DataFrame:
    """(area, lat, lon): a place inside each area, half way between the first two crossings of its border with a line through its middle."""
    middle = edges.groupBy("area").agg(((F.min(F.least("lat1", "lat2")) + F.max(F.greatest("lat1", "lat2"))) / 2 + 1e-9).alias("lat"))
    cut = edges.join(middle, "area").where((F.least("lat1", "lat2") <= F.col("lat")) & (F.col("lat") < F.greatest("lat1", "lat2")))
    x = F.col("lon1") + (F.col("lat") - F.col("lat1")) / (F.col("lat2") - F.col("lat1")) * (F.col("lon2") - F.col("lon1"))
    crossings = cut.groupBy("area", "lat").agg(F.min(x).alias("a"), F.sort_array(F.collect_list(x))[1].alias("b"))  # a border's crossings of one line
    return crossings.select("area", "lat", ((F.col("a") + F.col("b")) / 2).alias("lon"))


def _order(level: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, LEVELS)), level)


def among(areas: DataFrame, edges: DataFrame) -> DataFrame:
    """(area, level, name, district) of areas (area, level, name) that are towns: municipalities, and of the areas above them those that have
    no area of a lower level in them. An area is in another if a place inside it is. district is the name of the district that a municipality is in; null for
    other towns. Areas whose border is not whole are left out."""
    closed = whole(edges)
    areas = areas.where(F.col("level").isin(*LEVELS)).join(closed.select("area").distinct(), "area", "left_semi")
    within = joins.point_in_polygon(points_inside(closed).withColumnRenamed("area", "inner"), ("lat", "lon"), "inner", closed, "area").where("inner <> area")
    lower = areas.select(F.col("area").alias("inner"), _order(F.col("level")).alias("_below"))
    within = within.join(lower, "inner").join(areas.select("area", _order(F.col("level")).alias("_above"), F.col("level").alias("_level"), F.col("name").alias("_name")), "area")
    within = within.where(F.col("_below") < F.col("_above"))
    towns = areas.join(within.select("area").distinct(), "area", "left_anti")
    district = within.where((F.col("_level") == LEVELS[1]) & (F.col("_below") == 1)).groupBy(F.col("inner").alias("area")).agg(F.min_by("_name", "area").alias("district"))
    return towns.join(district, "area", "left")


def of_stations(stations: DataFrame, key: str, towns: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, area) of stations (lat, lon) in a town; one in two of them is in that of the lower level, then of the smaller number."""
    inside = joins.point_in_polygon(stations, ("lat", "lon"), key, edges.join(towns.select("area"), "area", "left_semi"), "area")
    return inside.join(towns.select("area", "level"), "area").groupBy(key).agg(F.min_by("area", F.struct(_order(F.col("level")), "area")).alias("area"))
