"""Vehicles under way: where they are, what they pass, and which are at one place."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STANDS_S = 15  # seconds that a vehicle stands on at its last stop
NEAR_IN_PX, NEAR_OUT_PX, SAME_WAY = 4, 8, 0.85  # apart on the screen; cosine of headings that are one


def sections(calls: DataFrame, now: Column) -> DataFrame:
    """The current section of every trip under way: calls (trip_id, pos, arr_s, dep_s, lat, lon) with arr2, lat2, lon2 of the next call.
    Calls that are over are left out by their times; a trip's next call comes by a window over its calls."""
    w = Window.partitionBy("trip_id").orderBy("pos")
    n = calls.withColumns({"arr2": F.lead("arr_s").over(w), "lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)})
    return n.where((F.col("arr_s") <= now) & (F.col("arr2").isNull() | (now < F.col("arr2"))) & ((now <= F.col("dep_s") + STANDS_S) | F.col("arr2").isNotNull()))


def positions(calls: DataFrame, now: Column) -> DataFrame:
    """(trip_id, pos, lat, lon) of every trip under way: at a stop, or in proportion between two."""
    n = sections(calls, now)
    still = (now <= F.col("dep_s")) | F.col("arr2").isNull() | (F.col("arr2") <= F.col("dep_s"))
    share = (now - F.col("dep_s")) / F.nullif(F.col("arr2") - F.col("dep_s"), F.lit(0)).cast("double")
    at = [F.when(still, F.col(c)).otherwise(F.col(c) + (F.col(f"{c}2") - F.col(c)) * share).alias(c) for c in ("lat", "lon")]
    return n.select("trip_id", "pos", *at)


def hops(calls: DataFrame) -> DataFrame:
    """(trip_id, pos, from_id, to_id, from_dep, to_arr) of neighbouring calls at different stops; pos is the later call's."""
    w = Window.partitionBy("trip_id").orderBy("pos")
    x = calls.withColumns({"from_id": F.lag("stop_id").over(w), "from_dep": F.lag("dep_s").over(w)}).where("from_id <> stop_id")
    return x.select("trip_id", "pos", "from_id", F.col("stop_id").alias("to_id"), "from_dep", F.col("arr_s").alias("to_arr"))


def knots(calls: DataFrame, since: Column, until: Column) -> DataFrame:
    """(trip_id, times): the arrivals and departures of a trip between two moments, in order."""
    events = F.array(*[F.struct(F.col(c).alias("t"), (F.col("pos") * 2 + i).alias("i")) for i, c in enumerate(("arr_s", "dep_s"))])
    s = calls.select("trip_id", F.inline(events)).where(F.col("t").between(since, until))
    return s.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("times"))


def relative_times(calls: DataFrame) -> DataFrame:
    """calls with arr, from the first departure of the trip on."""
    return calls.withColumn("arr", F.col("arr_s") - F.first("dep_s").over(Window.partitionBy("trip_id").orderBy("pos")))


def together(seen: DataFrame, screen: list[str]) -> DataFrame:
    """(screen, id, first) of (screen, id, x, y, heading, near): vehicles at one place, by the first of them, in the order of ids.

    A vehicle joins the first place whose first vehicle is within NEAR_IN_PX both ways (NEAR_OUT_PX if near says that it was at that
    vehicle's place before) and heads the same way or, like it, stands. A choice depends on those before; a screen holds as many
    vehicles as the thinning lets on it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        firsts: dict[tuple[int, int], list] = {}
        out = []
        for r in rows.sort_values("id").itertuples(index=False):
            cy, cx = math.floor(r.y / NEAR_OUT_PX), math.floor(r.x / NEAR_OUT_PX)
            around = sorted((f for dy in (-1, 0, 1) for dx in (-1, 0, 1) for f in firsts.get((cy + dy, cx + dx), ())), key=lambda f: f[0])
            for n, i, x, y, heading in around:
                reach = NEAR_OUT_PX if r.near == i else NEAR_IN_PX
                alone = pd.isna(r.heading) or pd.isna(heading)
                same = pd.isna(r.heading) and pd.isna(heading) if alone else math.cos(r.heading - heading) > SAME_WAY
                if abs(r.x - x) <= reach and abs(r.y - y) <= reach and same:
                    out.append((r.id, i))
                    break
            else:
                firsts.setdefault((cy, cx), []).append((len(out), r.id, r.x, r.y, r.heading))
                out.append((r.id, r.id))
        head = [[rows[c].iloc[0]] * len(out) for c in screen]
        return pd.DataFrame({**dict(zip(screen, head, strict=True)), "id": [a for a, _ in out], "first": [b for _, b in out]})

    kinds = dict(seen.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in screen) + f", id {kinds['id']}, first {kinds['id']}"
    return seen.groupBy(*screen).applyInPandas(run, schema)
