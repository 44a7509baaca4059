"""Lines as a whole: the ways they go, from the runs of their trips, and their places in addresses."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .tables import discard, materialise

UP, DOWN, UNSURE = 0, 1, 2
FEW_RUNS = 1000  # the runs of a line, busiest first, that have their rounds first


def _calls(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _run, _k, _stop) of runs (keys, stops, trips): _run from 1 is a run's rank, the busiest first, of as busy ones the longer, then the first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("trips"), F.desc(F.size("stops")), "stops"))
    return runs.withColumn("_run", rank).select(*keys, "_run", F.posexplode("stops").alias("_k", "_stop"))


def _parts(calls: DataFrame, order: DataFrame, keys: list[str], run: list[str]) -> DataFrame:
    """(keys, run, _start, _part, _at) of every part of calls, stops in a row that the list order (keys, _at, _stop) lacks. _at is where in the list it may go:
    between its neighbours where they follow each other there, or beyond the end that its only neighbour is; else null."""
    index = order.groupBy(*keys, "_stop").agg(F.max("_at").alias("_at"))
    size = order.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    by = Window.partitionBy(*keys, *run).orderBy("_k")
    known = calls.join(index, [*keys, "_stop"], "left").withColumns({
        "_island": F.count("_at").over(by),
        "_before": F.last("_at", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.first("_at", ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)),
    })
    parts = known.where("_at IS NULL").groupBy(*keys, *run, "_island").agg(
        F.min("_k").alias("_start"), F.array_sort(F.collect_list(F.struct("_k", "_stop"))).alias("_p"), F.min("_before").alias("_before"), F.min("_after").alias("_after"))
    between = F.when(F.col("_after") > F.col("_before"), F.col("_after"))
    at = F.when(F.col("_before").isNull(), F.when(F.col("_after") == 0, 0)).when(F.col("_after").isNull(), F.when(F.col("_before") == F.col("_size") - 1, F.col("_size"))).otherwise(between)
    return parts.join(size, keys).select(*keys, *run, "_start", F.col("_p._stop").alias("_part"), at.cast("int").alias("_at"))


def _merged(runs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(list, parts): (keys, _at, _stop), the busiest run with what the others add to it, and (keys, _run, _start, _part), the parts that found no place.

    The list of a key only changes by inserts, and all parts up to the next one meet the same list. So a round puts in, for all keys at once, the first
    part in order that has a place; those before it are settled. Runs that the list holds whole are dropped, and so are keys without
    a further insert: rounds are the inserts of one key, at most its stops. Most inserts come from the first runs, so these have their rounds
    before the many later ones are looked at."""
    every = materialise(_calls(runs, keys), "calls")
    order = materialise(every.where("_run = 1").select(*keys, F.col("_k").cast("int").alias("_at"), "_stop"), "order")
    settled, low, most = [], 1, every.agg(F.max("_run")).first()[0] or 1
    for high in (FEW_RUNS, None):
        if most <= low:
            break
        chunk = calls = every.where(F.col("_run") > low) if high is None else every.where(F.col("_run").between(low + 1, high))
        order, parts = _inserted(calls, chunk, order, keys)
        settled, low = [*settled, *parts], high
    if not settled:
        settled = [every.where("false").select(*keys, "_run", F.lit(0).alias("_start"), F.array("_stop").alias("_part"))]
    return order, functools.reduce(DataFrame.unionByName, settled)


def _inserted(calls: DataFrame, every: DataFrame, order: DataFrame, keys: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """(order, settled) after the rounds over some runs in a row, all calls of which are every."""
    cursor = order.select(*keys).distinct().withColumns({"_r": F.lit(1), "_s": F.lit(-1)})
    settled = []
    while True:
        parts = _parts(calls, order, keys, ["_run"]).join(cursor, keys).where("_run > _r OR (_run = _r AND _start > _s)").drop("_r", "_s")
        placed = Observation()
        parts = materialise(parts.observe(placed, F.count("_at").alias("n")), "parts")
        first = parts.where("_at IS NOT NULL").groupBy(*keys).agg(F.min(F.struct("_run", "_start", "_part", "_at")).alias("_n"))
        first = first.select(*keys, F.col("_n._run").alias("_r"), F.col("_n._start").alias("_s"), F.col("_n._part").alias("_new"), F.col("_n._at").alias("_p"))
        first = materialise(first, "first")  # a row a key
        cursor = first.select(*keys, "_r", "_s")
        passed = parts.join(cursor, keys, "left").where("_at IS NULL AND (_r IS NULL OR _run < _r OR (_run = _r AND _start < _s))")
        settled.append(passed.select(*keys, "_run", "_start", "_part"))
        if not placed.get["n"]:
            return order, settled
        shift = F.when(F.col("_at") >= F.col("_p"), F.size("_new")).otherwise(0)
        moved = order.join(first, keys, "left").select(*keys, (F.col("_at") + F.coalesce(shift, F.lit(0))).cast("int").alias("_at"), "_stop")
        put = first.select(*keys, "_p", F.posexplode("_new").alias("_i", "_stop")).select(*keys, (F.col("_p") + F.col("_i")).cast("int").alias("_at"), "_stop")
        old, order = order, materialise(moved.unionByName(put), "order")
        discard(old)
        # of keys with an insert, the calls of runs that still lack a stop
        calls = every.join(parts.join(cursor, keys).where("_run >= _r").select(*keys, "_run").distinct(), [*keys, "_run"], "left_semi")


def ways(runs: DataFrame, line: list[str]) -> DataFrame:
    """(line, direction, list, branches) of (line, stops, trips): one or two ways of each line.

    The busiest run (of as busy ones the longer, then the first) is the way UP. Others go up or down along it by more of their steps between
    stops that it has too. A run without more of either goes where fewer of its stops would be on branches, a step back along the list counting
    as all of it; up if no run goes down. A stop is on one branch at most, the first, and on none if it is in the list. All of it is joins and windows over
    (line, run, stop), so neither a line nor a direction is a group of Python."""
    keys = [*line, "direction"]
    x = materialise(runs.withColumn("_id", F.xxhash64("stops")), "runs")
    rank = F.row_number().over(Window.partitionBy(*line).orderBy(F.desc("trips"), F.desc(F.size("stops")), "stops"))
    busiest = x.withColumn("_i", rank).where("_i = 1").select(*line, F.col("_id").alias("_top"), F.col("stops").alias("_main"))
    along = busiest.select(*line, F.posexplode("_main").alias("_at", "_stop")).groupBy(*line, "_stop").agg(F.max("_at").alias("_at"))
    calls = x.select(*line, "_id", F.posexplode("stops").alias("_k", "_stop")).join(along, [*line, "_stop"])
    step = F.signum(F.col("_at") - F.lag("_at").over(Window.partitionBy(*line, "_id").orderBy("_k")))
    steps = calls.withColumn("_step", step).groupBy(*line, "_id").agg(F.sum("_step").alias("_sum"))
    side = F.when(F.col("_id") == F.col("_top"), UP).when(F.col("_sum") > 0, UP).when(F.col("_sum") < 0, DOWN).otherwise(UNSURE)
    x = x.join(busiest, line).join(steps, [*line, "_id"], "left").select(*line, "_id", "stops", "trips", side.alias("direction"))
    x = materialise(x, "sides")
    sides = x.groupBy(*line).agg(F.max(F.col("direction") == DOWN).alias("_down"), F.max(F.col("direction") == UNSURE).alias("_open"))
    torn = sides.where("_down AND _open").select(*line)
    lists, _ = _merged(x.join(torn, line, "left_semi").where(F.col("direction") != UNSURE).drop("_id"), keys)
    unsure = x.where(F.col("direction") == UNSURE).join(torn, line, "left_semi").select(*line, "_id", "stops")
    tries = unsure.withColumn("direction", F.explode(F.array(F.lit(UP), F.lit(DOWN))))
    tried = tries.select(*keys, "_id", F.posexplode("stops").alias("_k", "_stop"))
    off = _parts(tried, lists, keys, ["_id"]).where("_at IS NULL").groupBy(*keys, "_id").agg(F.sum(F.size("_part")).alias("_off"))
    index = lists.groupBy(*keys, "_stop").agg(F.max("_at").alias("_at"))
    back = F.col("_at") < F.lag("_at").over(Window.partitionBy(*keys, "_id").orderBy("_k"))
    backs = tried.join(index, [*keys, "_stop"]).withColumn("_back", back).groupBy(*keys, "_id").agg(F.count_if("_back").alias("_backs"))
    size = lists.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    cost = F.coalesce("_off", F.lit(0)) + F.coalesce("_backs", F.lit(0)) * F.col("_size")
    costs = tries.drop("stops").join(size, keys).join(off, [*keys, "_id"], "left").join(backs, [*keys, "_id"], "left")
    chosen = costs.groupBy(*line, "_id").agg(F.min_by("direction", F.struct(cost, F.col("direction"))).alias("_to"))
    x = x.join(chosen, [*line, "_id"], "left")
    x = x.withColumn("direction", F.when(F.col("direction") == UNSURE, F.coalesce("_to", F.lit(UP))).otherwise(F.col("direction"))).drop("_to", "_id")
    order, settled = _merged(materialise(x, "sides"), keys)
    listed = order.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_stop")))["_stop"].alias("list"))  # a line's stops
    loose = settled.select(*keys, "_run", "_start", F.posexplode("_part").alias("_i", "_stop")).join(order.select(*keys, "_stop"), [*keys, "_stop"], "left_anti")
    own = loose.groupBy(*keys, "_stop").agg(F.min(F.struct("_run", "_start", "_i")).alias("_o"))
    branch = own.groupBy(*keys, "_o._run", "_o._start").agg(F.array_sort(F.collect_list(F.struct("_o._i", "_stop")))["_stop"].alias("_b"))
    branches = branch.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_run", "_start", "_b")))["_b"].alias("branches"))
    none = F.array().cast(f"array<{dict(runs.dtypes)['stops']}>")
    return listed.join(branches, keys, "left").select(*keys, "list", F.coalesce("branches", none).alias("branches"))


def places(lines: DataFrame, address: str, lat: str, lon: str) -> DataFrame:
    """lines with place: null for the only line of an address; of several their places to two decimals, or to four where two of
    them would be the same."""
    by = Window.partitionBy(address)
    two, four = (F.format_string(f"%.{n}f,%.{n}f", F.col(lat), F.col(lon)) for n in (2, 4))
    n, apart = F.count(F.lit(1)).over(by), F.size(F.collect_set(two).over(by))
    return lines.withColumn("place", F.when(n > 1, F.when(apart == n, two).otherwise(four)))


def first_of_name(stations: DataFrame, name: str, key: str, service: str, lat: str, lon: str) -> DataFrame:
    """(name, key): of stations named alike the busiest, of as busy ones the southernmost, then the westernmost."""
    order = F.struct((-F.col(service)).alias("a"), F.col(lat).alias("b"), F.col(lon).alias("c"), F.col(key).alias("d"))
    return stations.groupBy(name).agg(F.min_by(key, order).alias(key))


def towns_along(calls: DataFrame) -> DataFrame:
    """calls (trip_id, pos, town_id) with town: that of each call, null on trips that stay in one town."""
    by = Window.partitionBy("trip_id")
    return calls.withColumn("town", F.when(F.min("town_id").over(by) != F.max("town_id").over(by), F.col("town_id")))


def headsigns(calls: DataFrame, own: Column, name: str) -> DataFrame:
    """calls (trip_id, pos) with sign: the call's own, else the name of the trip's last stop."""
    whole = Window.partitionBy("trip_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return calls.withColumn("sign", F.coalesce(own, F.last(name).over(whole)))


def day_holds(today: Column, day: Column, now: Column, last: Column) -> Column:
    """Whether what is said of a service day still holds: on that date, and on the one after it up to its last departure."""
    return day.isNull() | (today <= day) | (F.coalesce((today == F.date_add(day, 1)) & (now <= last), F.lit(False)))


def today_said(now: Column, first: Column, last: Column) -> Column:
    """What a day's line starts with: none, over, first (the first departure is still to come) or now."""
    return F.when(first.isNull(), "none").when(now > last, "over").when(now < first, "first").otherwise("now")
