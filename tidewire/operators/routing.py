"""Cheapest paths of many hops over a map's networks at once: rounds of joins from arc to arc, so neither a hop nor a network has a task of its
own, and no tile has borders."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geo
from . import map_view
from .tables import discard, materialise

AHEAD = 2.0  # metres of way that bring a route a metre closer to a stop the network does not reach
MOST_CANDIDATES = 6


def arcs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(arc, edge, a, b, cost, metres, x1, y1, x2, y2, lat1, lon1, lat2, lon2) of edges (edge, a, b, cost in per cent, direction) between nodes (id, lat,
    lon), one a direction that may be used; x and y are metres in a plane around the arc's latitude. Further columns of edges stay."""
    more = [c for c in edges.columns if c not in {"edge", "a", "b", "cost", "direction"}]
    for end in ("a", "b"):
        edges = edges.join(nodes.select(F.col("id").alias(end), F.col("lat").alias(f"lat_{end}"), F.col("lon").alias(f"lon_{end}")), end)
    metres = geo.metres(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    both = edges.withColumns({"metres": metres, "east": F.cos(F.radians((F.col("lat_a") + F.col("lat_b")) / 2))})
    way = lambda p, q, back: F.struct(
        F.lit(back).alias("back"), F.col(p).alias("a"), F.col(q).alias("b"), *[
            (F.col(f"{c}_{e}") * geo.METRES_PER_DEGREE * (F.col("east") if c == "lon" else 1)).alias(n) for e, i in ((p, 1), (q, 2)) for c, n in (("lon", f"x{i}"), ("lat", f"y{i}"))],
        *[F.col(f"{c}_{e}").alias(f"{c}{i}") for e, i in ((p, 1), (q, 2)) for c in ("lat", "lon")])
    ways = F.filter(F.array(F.when(F.col("direction") >= 0, way("a", "b", 0)), F.when(F.col("direction") <= 0, way("b", "a", 1))), lambda w: w.isNotNull())
    out = both.select(*more, "edge", (F.col("metres") * F.col("cost") / 100).alias("cost"), "metres", F.explode(ways).alias("w"))
    return out.select((F.col("edge") * 2 + F.col("w.back")).alias("arc"), "edge", "w.a", "w.b", "cost", "metres", *[f"w.{c}{i}" for i in (1, 2) for c in ("x", "y")], *[f"w.{c}{i}" for i in (1, 2) for c in ("lat", "lon")], *more)


def candidates(stops: DataFrame, nodes: DataFrame, edges: DataFrame, radius_m: float, penalty: float) -> DataFrame:
    """(stop, edge, t, cost) of stops (stop, lat, lon): the MOST_CANDIDATES nearest edges within radius_m, the place on each from 0 at a to 1 at
    b, and what the way to it costs."""
    for end, i in (("a", 1), ("b", 2)):
        edges = edges.join(nodes.select(F.col("id").alias(end), F.col("lon").alias(f"x{i}"), F.col("lat").alias(f"y{i}")), end)
    points = stops.select(F.col("stop").alias("id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    near = map_view.snap(points, edges.select("edge", "x1", "y1", "x2", "y2"), radius_m, MOST_CANDIDATES)
    k = F.cos(F.radians("y"))
    ex, ey = (F.col("x2") - F.col("x1")) * k, F.col("y2") - F.col("y1")
    t = ((F.col("x") - F.col("x1")) * k * ex + (F.col("y") - F.col("y1")) * ey) / F.nullif(ex * ex + ey * ey, F.lit(0.0))
    return near.select(F.col("id").alias("stop"), "edge", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(t, F.lit(0.0)))).alias("t"), (F.col("metres") * penalty).alias("cost"))


def _turns(one: str, two: str, max_turn: float | None) -> Column:
    """Whether a route may go on from arc one to arc two: by at most max_turn degrees; null: anywhere."""
    if max_turn is None:
        return F.lit(True)
    d = {f"{c}{n}": F.col(f"{n}.{c}2") - F.col(f"{n}.{c}1") for n in (one, two) for c in "xy"}
    dot = d[f"x{one}"] * d[f"x{two}"] + d[f"y{one}"] * d[f"y{two}"]
    size = F.sqrt((d[f"x{one}"] ** 2 + d[f"y{one}"] ** 2) * (d[f"x{two}"] ** 2 + d[f"y{two}"] ** 2))
    return dot >= size * (math.cos(math.radians(max_turn)) - 1e-12)


def routes(
    hops: DataFrame, ends: DataFrame, ways: DataFrame, max_turn: float | None = None, beyond: DataFrame | None = None, stops: DataFrame | None = None, near_m: float | None = None,
    report: list[tuple[int, int]] | None = None,
) -> DataFrame:
    """(hop, cost, path, reaches) of hops (hop, source, target, most): the cheapest way from any candidate of the stop source to any of target
    (ends, see candidates) that costs at most most, as the arcs it uses, the first and last in part. Ties go to the smaller arc, from the end back.

    A round takes every way that the last one improved one arc further and keeps, per hop and arc, the cheapest, with the arc before it; ways that cost more
    than most or than the hop's cheapest whole way so far go no further. With stops (stop, lat, lon) the rounds are guided: what a way costs so far and the
    straight line left to its target, at the least cost of a metre, must not be more either. So a hop's rows are the arcs that may be on its way, the rounds are the arcs of the
    longest cheapest way, and the work of a round is joins on nodes of narrow rows; paths are only put together for the ways that are found. With near_m, a
    hop whose column far is true goes by arcs whose column main is true, and by others only within near_m of its two stops. report gets (round, rows) of each.
    With beyond (stop, x, y in the plane of ways), hops that no way reaches go as far as the place from where the way so far and AHEAD times the straight line
    left is least (reaches is false)."""
    place = ends.withColumnRenamed("cost", "extra")
    ways = materialise(ways, "arcs")
    facts = hops.select("hop", "most", *(["far"] if near_m is not None else []), "source", "target")
    pace = 0.0
    if stops is not None:
        for end, c in (("source", "s"), ("target", "t")):
            facts = facts.join(stops.select(F.col("stop").alias(end), F.col("lat").alias(f"{c}_lat"), F.col("lon").alias(f"{c}_lon")), end)
        pace = ways.where("metres > 0").agg(F.min(F.col("cost") / F.col("metres"))).first()[0] or 0.0
    facts = materialise(facts.drop("source", "target"), "facts")
    extra = ["lat2", "lon2"] if stops is not None else []
    extra += ["main"] if near_m is not None else []

    def open_ways(rows: DataFrame) -> DataFrame:
        """Of rows (hop, arc, cost, prev, extra) those that may be on a way."""
        rows = rows.join(facts, "hop")
        left = F.lit(0.0)
        if stops is not None:
            left = 0.99 * pace * geo.metres(F.col("lat2"), F.col("lon2"), F.col("t_lat"), F.col("t_lon"))  # what distances on a plane may be off
        keep = F.col("cost") + left <= F.col("most")
        if near_m is not None:
            close = [geo.metres(F.col("lat2"), F.col("lon2"), F.col(f"{c}_lat"), F.col(f"{c}_lon")) <= near_m for c in "st"]
            keep &= ~F.col("far") | F.col("main") | close[0] | close[1]
        return rows.where(keep).withColumn("_left", left).select("hop", "arc", "cost", "prev", "_left")

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("hop", "arc").agg(F.min(F.struct("cost", "prev")).alias("_m")).select("hop", "arc", "_m.cost", "_m.prev")

    on = ways.join(place, "edge").withColumn("back", F.col("arc") != F.col("edge") * 2)
    part = F.when(F.col("back"), F.col("t")).otherwise(1 - F.col("t"))  # of an arc, what is left behind a place on it
    none = F.lit(None).cast(dict(ways.dtypes)["arc"])
    starts = hops.join(on, F.col("source") == F.col("stop")).select("hop", "arc", (F.col("extra") + part * F.col("cost")).alias("cost"), none.alias("prev"), *extra)
    goals = hops.join(on, F.col("target") == F.col("stop")).select("hop", "arc", "a", "x1", "y1", "x2", "y2", (F.col("extra") + (1 - part) * F.col("cost")).alias("cost"))
    goals = materialise(goals, "goals")
    # both stops on one arc: no search
    first = hops.join(on, F.col("source") == F.col("stop")).select("hop", "arc", "most", "extra", part.alias("left"), "cost")
    last = hops.join(on, F.col("target") == F.col("stop")).select("hop", "arc", F.col("extra").alias("extra2"), part.alias("left2"))
    same = first.join(last, ["hop", "arc"]).where("left >= left2").select("hop", "most", (F.col("extra") + F.col("extra2") + (F.col("left") - F.col("left2")) * F.col("cost")).alias("cost"), "arc")
    least = lambda rows: rows.groupBy("hop").agg(F.min(F.struct("cost", "goal", "last")).alias("_m")).select("hop", "_m.*")
    whole = materialise(least(same.where("cost <= most").select("hop", "cost", F.col("arc").alias("goal"), none.alias("last"))), "whole")
    known = front = materialise(best(open_ways(starts)), "front")
    arc = F.struct("arc", "b", "x1", "y1", "x2", "y2").alias("one")
    turn = 0
    while True:
        at = front.join(ways.select("arc", arc), "arc").select("hop", "cost", "one")
        goal = goals.select("hop", F.col("cost").alias("more"), F.struct("arc", "a", "x1", "y1", "x2", "y2").alias("two"))
        ended = at.join(goal, "hop").where((F.col("one.b") == F.col("two.a")) & _turns("one", "two", max_turn)).join(facts.select("hop", "most"), "hop")
        ended = ended.select("hop", (F.col("cost") + F.col("more")).alias("cost"), F.col("two.arc").alias("goal"), F.col("one.arc").alias("last"), "most").where("cost <= most").drop("most")
        old, whole = whole, materialise(least(whole.unionByName(ended)), "whole")
        step = ways.select(F.struct("arc", "a", "x1", "y1", "x2", "y2").alias("two"), F.col("cost").alias("more"), *extra)
        further = at.join(step, F.col("one.b") == F.col("two.a")).where(_turns("one", "two", max_turn))
        further = open_ways(further.select("hop", F.col("two.arc").alias("arc"), (F.col("cost") + F.col("more")).alias("cost"), F.col("one.arc").alias("prev"), *extra))
        further = further.join(whole.select("hop", F.col("cost").alias("_w")), "hop", "left").where("_w IS NULL OR cost + _left < _w")
        seen = known.select("hop", "arc", F.col("cost").alias("_c"))
        rows = Observation()
        better = best(further).join(seen, ["hop", "arc"], "left").where("_c IS NULL OR cost < _c").drop("_c")
        gone, front = front, materialise(better.observe(rows, F.count(F.lit(1)).alias("n")), "front")
        discard(old)
        turn += 1
        if report is not None:
            report.append((turn, rows.get["n"]))
        if not rows.get["n"]:
            break
        before, known = known, materialise(best(known.unionByName(front)), "known")
        discard(before, gone)
    ended = whole.select("hop", F.col("cost"), F.col("goal"), F.col("last"), F.lit(True).alias("reaches"))
    if beyond is not None:
        aim = hops.join(beyond.withColumnRenamed("stop", "target"), "target").select("hop", F.col("x").alias("_x"), F.col("y").alias("_y"))
        left = F.hypot(F.col("x2") - F.col("_x"), F.col("y2") - F.col("_y"))
        exits = known.join(whole.select("hop"), "hop", "left_anti").join(aim, "hop").join(ways.select("arc", "x2", "y2"), "arc")
        exits = exits.groupBy("hop").agg(F.min_by(F.struct("cost", "arc", "prev"), F.struct(F.col("cost") + AHEAD * left, F.col("arc"))).alias("_m"))
        ended = ended.unionByName(exits.select("hop", "_m.cost", F.col("_m.arc").alias("goal"), F.col("_m.prev").alias("last"), F.lit(False).alias("reaches")))
    ended = materialise(ended, "ended")
    out = hops.select("hop").join(ended.join(_chains(ended, known), "hop", "left"), "hop", "left")
    path = F.when(F.col("goal").isNotNull(), F.concat(F.coalesce("_before", F.array().cast(f"array<{dict(ways.dtypes)['arc']}>")), F.array("goal")))
    return out.select("hop", "cost", path.alias("path"), F.coalesce("reaches", F.lit(False)).alias("reaches"))


def _chains(ended: DataFrame, known: DataFrame) -> DataFrame:
    """(hop, _before): the arcs before each hop's last, followed back from arc to arc for all hops at once."""
    now = materialise(ended.where("last IS NOT NULL").select("hop", F.col("last").alias("arc"), F.lit(0).alias("n")), "chain")
    pieces = [now]
    while not now.isEmpty():
        back = now.join(known.select("hop", "arc", "prev"), ["hop", "arc"]).where("prev IS NOT NULL")
        now = materialise(back.select("hop", F.col("prev").alias("arc"), (F.col("n") + 1).alias("n")), "chain")
        pieces.append(now)
    every = functools.reduce(DataFrame.unionByName, pieces)
    return every.groupBy("hop").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "arc"))), lambda x: x["arc"]).alias("_before"))
