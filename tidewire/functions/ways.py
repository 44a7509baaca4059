"""What the tags of a map's ways say: the network a way belongs to, its cost, directions and speed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values

#: km/h by kind of road and track, where a way has no limit
ROAD_SPEED = {
    "motorway": 100, "trunk": 80, "primary": 50, "secondary": 50, "tertiary": 50, "unclassified": 40, "residential": 30, "living_street": 10,
    "service": 20, "busway": 50, "bus_guideway": 60, "pedestrian": 10,
}
RAIL_SPEED = {"rail": 100, "light_rail": 70, "subway": 60, "tram": 40, "narrow_gauge": 40, "monorail": 40, "funicular": 15}
OTHER_SPEED = 20
#: the most a bus drives, on motorways and trunk roads and elsewhere; its share of limits up to so many km/h
BUS_MOST_FAST, BUS_MOST = 100, 80
TOWN_SHARE = ((50, 0.6), (70, 0.8))
#: limits that have names
IMPLIED_SPEED = {
    "DE:urban": 50, "DE:rural": 100, "DE:motorway": 130, "DE:living_street": 7, "DE:zone30": 30, "DE:zone:30": 30, "walk": 7, "none": 130,
}
KMH_OF_MPH = 1.609
#: cost by kind of road, against a main road; of service tracks, against a running line
ROAD_FACTOR = {
    "motorway": 1.0, "trunk": 1.0, "primary": 1.0, "secondary": 1.0, "tertiary": 1.0, "unclassified": 1.15, "residential": 1.3, "living_street": 2.0,
    "service": 1.6, "busway": 1.0, "bus_guideway": 1.0, "pedestrian": 2.5,
}
SERVICE_FACTOR = {"yard": 3.0, "spur": 3.0, "siding": 1.5, "crossover": 1.2}
SHARED_FACTOR = 1.5  # of a way that is shared with another network, there
REFUSED = ("no", "private", "agricultural", "forestry", "emergency", "military")
NOT_A_ROAD = ("parking_aisle", "driveway", "drive-through", "emergency_access")
AERIALWAYS = ("cable_car", "gondola", "mixed_lift", "chair_lift")
MAIN_ROADS = ("motorway", "trunk", "primary")
NETS = ("road", "rail", "tram", "subway", "cable", "ferry")

WAY = "struct<net:string,factor:double,direction:int,shared:array<string>,main:boolean,speed:int>"


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _found(values: Mapping[str, float], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))]), key)


def _is(c: Column, *values: str) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False))


def _yes(c: Column) -> Column:
    return _is(c, "yes", "designated")


def maxspeed(tags: Column) -> Column:
    """km/h of a way's limit, whichever direction has one; null where there is none that can be read. A number may be followed
    by anything; by mph it counts miles."""
    written = F.coalesce(*[tag(tags, k) for k in ("maxspeed", "maxspeed:forward", "maxspeed:backward")])
    number = F.regexp_extract(written, r"^(\d+(?:\.\d+)?)", 1)
    miles = F.regexp_like(written, F.lit(r"^\d+(?:\.\d+)?\s*mph"))
    return F.coalesce(_found(IMPLIED_SPEED, written), F.when(number != "", number.cast("double") * F.when(miles, KMH_OF_MPH).otherwise(1.0)))


def oneway(tags: Column, implied: Column) -> Column:
    """1 along the way, -1 against it, 0 both ways; implied: a way that says nothing goes along."""
    v = tag(tags, "oneway")
    return F.when(v.isin("yes", "true", "1"), 1).when(v.isin("-1", "reverse"), -1).when(v.isNull() & implied, 1).otherwise(0)


def _kept_speed(kmh: Column) -> Column:
    """Half the km/h, in a byte."""
    return F.least(F.lit(255), F.greatest(F.lit(3), F.floor(kmh / 2 + 0.5))).cast("int")


def _way(net: Column | str, factor: Column, direction: Column, shared: Column, main: Column, kmh: Column) -> Column:
    net = F.lit(net) if isinstance(net, str) else net
    return F.struct(
        net.alias("net"), factor.cast("double").alias("factor"), direction.cast("int").alias("direction"), shared.alias("shared"), main.alias("main"),
        _kept_speed(kmh).alias("speed")).cast(WAY)


def _tracks(tags: Column) -> Column:
    railway, rack = tag(tags, "railway"), tag(tags, "rack")
    has_rack = rack.isNotNull() & (rack != "no")
    factor = F.coalesce(_found(SERVICE_FACTOR, tag(tags, "service")), F.lit(1.0))
    kmh = F.coalesce(maxspeed(tags), _found(RAIL_SPEED, railway), F.lit(float(OTHER_SPEED)))
    climbs = _is(railway, "monorail", "funicular", "narrow_gauge") | _is(tag(tags, "aerialway"), *AERIALWAYS) | (has_rack & _is(railway, "rail", "light_rail", "tram"))
    shared_by = {  # by kind of track: its network, and those that run on it too
        "narrow_gauge": ["rail"], "subway": ["tram"], "tram": ["subway", "rail"], "light_rail": ["subway", "tram"],
    }
    none = F.array().cast("array<string>")
    shared = none
    for kind, nets in shared_by.items():
        shared = F.when(railway == kind, F.array(*map(F.lit, nets))).otherwise(shared)
    cable = _way("cable", factor, F.lit(0), F.when(has_rack | (railway != "narrow_gauge") | railway.isNull(), none).otherwise(shared), F.lit(False), kmh)
    net = F.when(railway == "light_rail", "rail").otherwise(railway)
    # signals say the usual direction of a main line; only trams and undergrounds keep to it
    direction = F.when(railway.isin("tram", "subway"), oneway(tags, F.lit(False))).otherwise(0)
    return F.when(climbs, cable).when(_is(railway, "rail", "light_rail", "subway", "tram"), _way(net, factor, direction, shared, F.lit(False), kmh))


def _road(tags: Column) -> Column:
    highway = tag(tags, "highway")
    kind = F.regexp_replace(highway, "_link$", "")
    cost = _found(ROAD_FACTOR, kind)
    for_buses = _yes(tag(tags, "bus")) | _yes(tag(tags, "psv")) | _is(kind, "busway", "bus_guideway")
    access = F.coalesce(*[tag(tags, k) for k in ("bus", "psv", "motor_vehicle", "vehicle", "access")])
    closed = _is(kind, "pedestrian") | _is(access, *REFUSED) | (_is(kind, "service") & _is(tag(tags, "service"), *NOT_A_ROAD))
    along = oneway(tags, _is(highway, "motorway") | _is(tag(tags, "junction"), "roundabout", "circular"))
    against = (
        _is(tag(tags, "oneway:bus"), "no") | _is(tag(tags, "oneway:psv"), "no") | _yes(tag(tags, "bus:backward")) | _yes(tag(tags, "psv:backward"))
        | _is(tag(tags, "busway"), "opposite_lane") | _is(tag(tags, "busway:left"), "opposite_lane") | _is(tag(tags, "busway:right"), "opposite_lane"))
    most = F.when(_is(kind, "motorway", "trunk"), BUS_MOST_FAST).otherwise(BUS_MOST)
    limit = F.least(F.coalesce(maxspeed(tags), _found(ROAD_SPEED, kind)), most.cast("double"))
    share = F.lit(1.0)
    for upto, part in reversed(TOWN_SHARE):
        share = F.when(limit <= upto, part).otherwise(share)
    way = _way("road", F.when(for_buses, 1.0).otherwise(cost), F.when(against, 0).otherwise(along), F.array().cast("array<string>"), _is(kind, *MAIN_ROADS), limit * share)
    return F.when(cost.isNotNull() & (for_buses | ~closed), way)


def classify(tags: Column) -> Column:
    """A way's network, cost against a main road or running line, direction (see oneway), the networks it is shared with (at SHARED_FACTOR
    times the cost), whether it is a main road, and its speed in units of 2 km/h; null where it is no way of any."""
    ferry = _way("ferry", F.lit(1.0), F.lit(0), F.array().cast("array<string>"), F.lit(False), F.lit(float(OTHER_SPEED)))
    tracks = _tracks(tags)
    return F.when(_is(tag(tags, "area"), "yes"), None).when(_is(tag(tags, "route"), "ferry"), ferry).otherwise(F.coalesce(tracks, _road(tags)))
