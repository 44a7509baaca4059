"""Composite timetable queries: vehicles, trips, stations, lines, thinning, realtime."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, hashing, text
from ..operators import aggregates as ag
from ..operators import frequency, graph, joins, map_view, numbers, routing, segments, vehicles
from ..operators import sequences as seq
from . import frequency_sql
from .registry import query
from .relational import boxes
from .transit import duck, table, view

NOW = 36_000
_KNOTS = "SELECT s.trip_id, s.pos, s.arr_s, s.dep_s, st.lat, st.lon FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id"
_VEH = f"""
k AS ({_KNOTS}), n AS (SELECT *, lead(arr_s) OVER w AS arr2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM k WINDOW w AS (PARTITION BY trip_id ORDER BY pos)),
p AS (SELECT trip_id, pos, CASE WHEN {NOW} <= dep_s OR arr2 IS NULL OR arr2 <= dep_s THEN lat ELSE lat + (lat2 - lat) * ({NOW} - dep_s) / CAST(arr2 - dep_s AS DOUBLE) END AS lat,
  CASE WHEN {NOW} <= dep_s OR arr2 IS NULL OR arr2 <= dep_s THEN lon ELSE lon + (lon2 - lon) * ({NOW} - dep_s) / CAST(arr2 - dep_s AS DOUBLE) END AS lon
  FROM n WHERE arr_s <= {NOW} AND (arr2 IS NULL OR {NOW} < arr2) AND ({NOW} <= dep_s + 15 OR arr2 IS NOT NULL))"""


def _vehicles(spark, d):
    k = view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops").select("stop_id", "lat", "lon"), "stop_id")
    return vehicles.positions(k, F.lit(NOW))


@query("q04_vehicles", duck(f"WITH {_VEH} SELECT p.trip_id, pos, mode, round(lat, 9) AS lat, round(lon, 9) AS lon FROM p JOIN {{dv_trips}} t ON t.trip_id = p.trip_id"))
def q04(spark, d):
    return _vehicles(spark, d).join(view(spark, d, "dv_trips"), "trip_id").select("trip_id", "pos", "mode", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("q05_coupling_units", duck("""
WITH RECURSIVE h AS (SELECT trip_id, from_id, to_id, from_dep, to_arr, mode, year(service_date) AS day FROM {dv_hops} JOIN {dv_trips} USING (trip_id) WHERE 36000 BETWEEN from_dep AND to_arr),
e AS (SELECT DISTINCT a.trip_id AS a, b.trip_id AS b FROM h a JOIN h b USING (from_id, to_id, from_dep, to_arr, mode, day)),
r AS (SELECT DISTINCT trip_id, trip_id AS seen FROM h UNION SELECT r.trip_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT trip_id, min(seen) AS unit FROM r GROUP BY trip_id"""))
def q05(spark, d):
    """Trips that travel a hop at the same times, in one mode and on one day, are coupled, and so are those coupled with them. Days are
    years here, as the tables have few trips a day."""
    h = view(spark, d, "dv_hops").where(f"{NOW} BETWEEN from_dep AND to_arr").join(view(spark, d, "dv_trips"), "trip_id")
    h = h.select("trip_id", "mode", F.year("service_date").alias("day"), F.struct("from_id", "to_id", "from_dep", "to_arr").alias("hop"))
    return graph.group_by_shared(h, "trip_id", "hop", ["mode", "day"]).select("trip_id", F.col("root").alias("unit"))


@query("q06_knots", duck(f"""
WITH k AS (SELECT trip_id, unnest([{{'t': arr_s, 'i': pos * 2}}, {{'t': dep_s, 'i': pos * 2 + 1}}]) AS s, lat FROM ({_KNOTS}))
SELECT trip_id, list(s.t ORDER BY s.i) AS times FROM k WHERE s.t BETWEEN {NOW} - 3600 AND {NOW} + 90 GROUP BY trip_id"""))
def q06(spark, d):
    return vehicles.knots(view(spark, d, "dv_stop_times"), F.lit(NOW - 3600), F.lit(NOW + 90))


@query("q07_position", duck(f"WITH {_VEH} SELECT trip_id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM p"))
def q07(spark, d):
    return _vehicles(spark, d).select("trip_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


def _map(spark, d):
    """Customers as vehicles: kinds, ranks and places enough to fill screens."""
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 5 < 3, "bus").when(F.col("c_custkey") % 5 == 3, "tram").otherwise("regional")
    spread = [hashing.mix(F.col("c_custkey") * 3 + i) / F.lit(float(1 << 32)) for i in (1, 2)]
    return c.select(F.col("c_custkey").alias("id"), kind.alias("mode"), hashing.mix(F.col("c_custkey")).alias("rank"),
                    (F.lit(48.0) + spread[0] * 4).alias("lat"), (F.lit(8.0) + spread[1] * 6).alias("lon"))


@query("q08_thinning_shares")
def q08(spark, d):
    """Tested for its bounds: screens within the budget, shares that never fall with the zoom."""
    return map_view.shares(_map(spark, d), budget=100, few=5)


@query("q09_thin_out")
def q09(spark, d):
    """Tested with its shares."""
    v = _map(spark, d)
    return map_view.thin_out(v, map_view.shares(v, budget=100, few=5), 6.5).select("id", "mode")


@query("v21_first_per_square", duck("""
SELECT mode, CAST(floor((n_lon + 180) / 360 * 2048) AS BIGINT) AS x, arg_min(stop_id, stop_id * 7919 % 101) AS id FROM (SELECT stop_id, CASE WHEN stop_id % 2 = 0 THEN 'bus' ELSE 'tram' END AS mode, lon AS n_lon FROM {dv_stops}) GROUP BY ALL"""))
def v21(spark, d):
    s = view(spark, d, "dv_stops").select("stop_id", F.when(F.col("stop_id") % 2 == 0, "bus").otherwise("tram").alias("mode"), F.floor(geo.mercator_x(F.col("lon")) * 2048).alias("x"), (F.col("stop_id") * 7919 % 101).alias("rank"))
    return s.groupBy("mode", "x").agg(F.min_by("stop_id", "rank").alias("id"))


@query("q12_next_per_way", duck("""
WITH h AS (SELECT from_id, to_id, line, trip_id, from_dep FROM {dv_hops} JOIN {dv_trips} USING (trip_id) WHERE from_dep >= 36000)
SELECT from_id, to_id, line, trip_id, from_dep FROM h QUALIFY row_number() OVER (PARTITION BY from_id, to_id, line ORDER BY from_dep, trip_id) = 1"""))
def q12(spark, d):
    h = view(spark, d, "dv_hops").where("from_dep >= 36000").join(view(spark, d, "dv_trips"), "trip_id")
    best = h.groupBy("from_id", "to_id", "line").agg(F.min(F.struct("from_dep", "trip_id")).alias("b"))
    return best.select("from_id", "to_id", "line", "b.trip_id", "b.from_dep")


@query("q13_directions", duck("SELECT from_id, to_id, count(*) AS trips, min(line) AS line FROM {dv_hops} JOIN {dv_trips} USING (trip_id) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY from_id, to_id")))
def q13(spark, d):
    return view(spark, d, "dv_hops").join(view(spark, d, "dv_trips"), "trip_id").groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("trips"), F.min("line").alias("line"))


@query("q14_trip_detail", duck("SELECT s.trip_id, any_value(t.line) AS line, list(st.name ORDER BY s.pos) AS stops, list(s.arr_s ORDER BY s.pos) AS arr FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id JOIN {dv_trips} t ON t.trip_id = s.trip_id GROUP BY s.trip_id"))
def q14(spark, d):
    s = view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops"), "stop_id")
    g = s.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "arr_s"))).alias("l")).join(view(spark, d, "dv_trips"), "trip_id")
    return g.select("trip_id", "line", F.transform("l", lambda x: x["name"]).alias("stops"), F.transform("l", lambda x: x["arr_s"]).alias("arr"))


@query("q15_line_vehicles", duck(f"WITH {_VEH} SELECT line, list(p.trip_id ORDER BY p.trip_id) AS trips FROM p JOIN {{dv_trips}} t ON t.trip_id = p.trip_id GROUP BY line"))
def q15(spark, d):
    return _vehicles(spark, d).join(view(spark, d, "dv_trips"), "trip_id").groupBy("line").agg(F.array_sort(F.collect_list("trip_id")).alias("trips"))


@query("q18_place_on_way", duck("""
SELECT trip_id, stop_id, from_id, to_id FROM (SELECT h.trip_id, h.from_id, h.to_id, st.stop_id FROM {dv_hops} h JOIN {dv_stops} st ON st.stop_id = h.from_id WHERE 36000 BETWEEN from_dep AND to_arr)"""))
def q18(spark, d):
    return view(spark, d, "dv_hops").where(f"{NOW} BETWEEN from_dep AND to_arr").select("trip_id", F.col("from_id").alias("stop_id"), "from_id", "to_id")


@query("q19_line_route", duck("SELECT DISTINCT line, from_id, to_id, f.lat AS lat1, f.lon AS lon1, t.lat AS lat2, t.lon AS lon2 FROM {dv_hops} h JOIN {dv_trips} USING (trip_id) JOIN {dv_stops} f ON f.stop_id = from_id JOIN {dv_stops} t ON t.stop_id = to_id"))
def q19(spark, d):
    h = view(spark, d, "dv_hops").join(view(spark, d, "dv_trips"), "trip_id").select("line", "from_id", "to_id").distinct()
    s = view(spark, d, "dv_stops")
    a = s.select(F.col("stop_id").alias("from_id"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    b = s.select(F.col("stop_id").alias("to_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return h.join(a, "from_id").join(b, "to_id").select("line", "from_id", "to_id", "lat1", "lon1", "lat2", "lon2")


@query("q20_stations", duck("SELECT st.station_id, min(st.name) AS name, count(*) AS service, list_sort(list(DISTINCT t.mode)) AS modes FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id JOIN {dv_trips} t ON t.trip_id = s.trip_id WHERE st.in_region GROUP BY st.station_id"))
def q20(spark, d):
    s = view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops").where("in_region"), "stop_id").join(view(spark, d, "dv_trips"), "trip_id")
    return s.groupBy("station_id").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("service"), F.array_sort(F.collect_set("mode")).alias("modes"))


@query("q24_along_minutes", duck("SELECT line, CAST(floor(list_sort(list(d))[len(list(d)) // 2 + 1] / 60.0e0 + 0.5e0) AS BIGINT) AS minutes FROM (SELECT trip_id, max(arr_s) - min(dep_s) AS d FROM {dv_stop_times} GROUP BY trip_id) JOIN {dv_trips} USING (trip_id) GROUP BY line"))
def q24(spark, d):
    s = view(spark, d, "dv_stop_times").groupBy("trip_id").agg((F.max("arr_s") - F.min("dep_s")).alias("d"))
    return s.join(view(spark, d, "dv_trips"), "trip_id").groupBy("line").agg(ag.minutes_median("d").alias("minutes"))


@query("q25_days_said", duck("SELECT agency, min(few) AS few, max(few) AS many, min(first) AS first, max(last) AS last FROM (SELECT agency, service_date, count(*) AS few, min(dep_s) AS first, max(dep_s) AS last FROM {dv_stop_times} JOIN {dv_trips} USING (trip_id) WHERE pos = 0 GROUP BY ALL) GROUP BY agency"))
def q25(spark, d):
    s = view(spark, d, "dv_stop_times").where("pos = 0").join(view(spark, d, "dv_trips"), "trip_id")
    day = s.groupBy("agency", "service_date").agg(F.count(F.lit(1)).alias("n"), F.min("dep_s").alias("f"), F.max("dep_s").alias("l"))
    return day.groupBy("agency").agg(F.min("n").alias("few"), F.max("n").alias("many"), F.min("f").alias("first"), F.max("l").alias("last"))


@query("q26_leaving_within_days", duck("SELECT DISTINCT st.station_id FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id JOIN {dv_trips} t ON t.trip_id = s.trip_id WHERE service_date BETWEEN (SELECT min(service_date) FROM {dv_trips}) AND (SELECT min(service_date) FROM {dv_trips}) + 3"))
def q26(spark, d):
    t = view(spark, d, "dv_trips")
    days = t.agg(F.min("service_date").alias("lo")).select(F.explode(F.sequence("lo", F.date_add("lo", 3))).alias("service_date"))
    trips = t.join(F.broadcast(days), "service_date", "left_semi").select("trip_id")  # four rows
    calls = view(spark, d, "dv_stop_times").join(trips, "trip_id", "left_semi").select("stop_id").distinct()
    return view(spark, d, "dv_stops").join(calls, "stop_id", "left_semi").select("station_id").distinct()


@query("q35_share_delays", duck("""
WITH r AS (SELECT h.trip_id, h.from_id, h.to_id, u.delay FROM {dv_hops} h LEFT JOIN {dv_updates} u ON u.trip_id = h.trip_id AND u.pos = h.pos),
c AS (SELECT from_id, to_id, delay, count(*) AS n FROM r WHERE delay IS NOT NULL GROUP BY ALL), a AS (SELECT from_id, to_id, arg_max(delay, n * 1000000 + delay) AS agreed FROM c GROUP BY ALL)
SELECT r.trip_id, r.from_id, r.to_id, coalesce(agreed, delay) AS delay FROM r LEFT JOIN a ON a.from_id = r.from_id AND a.to_id = r.to_id"""))
def q35(spark, d):
    u = view(spark, d, "dv_updates").select("trip_id", F.col("pos").cast("int").alias("pos"), "delay")
    r = view(spark, d, "dv_hops").join(u, ["trip_id", "pos"], "left")
    agreed = ag.agreed(r.where("delay IS NOT NULL").withColumn("own", F.lit(True)), ["from_id", "to_id"], "delay", "own")
    return r.join(agreed, ["from_id", "to_id"], "left").select("trip_id", "from_id", "to_id", F.coalesce("agreed", "delay").alias("delay"))


@query("q36_stop_numbers", duck("""
WITH s AS (SELECT stop_id, substr(name, 1, 9) AS slug, row_number() OVER (PARTITION BY substr(name, 1, 9) ORDER BY lat, lon, stop_id) AS number FROM {dv_stops})
SELECT stop_id, 'stop/' || lower(regexp_replace(slug, '[^a-zA-Z0-9]+', '-', 'g')) || CASE WHEN number > 1 THEN '/' || CAST(number AS VARCHAR) ELSE '' END AS path FROM s"""))
def q36(spark, d):
    s = view(spark, d, "dv_stops").withColumn("short", F.substring("name", 1, 9))
    n = F.row_number().over(Window.partitionBy("short").orderBy("lat", "lon", "stop_id"))
    return s.withColumn("n", n).select("stop_id", text.stop_path(F.lower(F.regexp_replace("short", "[^a-zA-Z0-9]+", "-")), F.col("n")).alias("path"))


_STATIONS = """SELECT c_custkey AS id, concat('n', c_nationkey * 6 + c_custkey % 6) AS name, c_acctbal AS service, 49.0e0 + (c_custkey * 7919 % 2000) / 1e5 AS lat, 11.0e0 + (c_custkey * 10477 % 2000) / 1e5 AS lon FROM {customer}"""


@query("q36_kept_numbers", duck(f"""
WITH RECURSIVE c AS ({_STATIONS}), one AS (SELECT * FROM c WHERE id % 7 <> 0), two AS (SELECT id, name, service, lat + 0.0007e0 * (id % 3) AS lat, lon FROM c WHERE id % 5 <> 0),
k AS (SELECT name, round(lat, 5) AS lat, round(lon, 5) AS lon, number FROM (SELECT id, name, lat, lon, CASE WHEN n < 2 THEN 0 ELSE row_number() OVER (PARTITION BY name ORDER BY f DESC, CASE WHEN high >= wide * cos(radians(mid)) THEN lat ELSE lon END, id) END AS number FROM (
  SELECT *, max(lat) OVER r - min(lat) OVER r AS high, max(lon) OVER r - min(lon) OVER r AS wide, (max(lat) OVER r + min(lat) OVER r) / 2 AS mid FROM (
    SELECT *, count(*) OVER (PARTITION BY name) AS n, row_number() OVER (PARTITION BY name ORDER BY service DESC, lat, lon, id) = 1 AS f FROM one) WINDOW r AS (PARTITION BY name, f))) WHERE number > 0),
p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY away, number, id) AS i FROM (
  SELECT two.name, two.id, k.number, sqrt(pow((k.lon - two.lon) * cos(radians((two.lat + k.lat) / 2)), 2) + pow(k.lat - two.lat, 2)) * 111320 AS away FROM two JOIN k USING (name)) WHERE away <= 300),
g AS (SELECT name, 0::BIGINT AS i, []::BIGINT[] AS ids, []::BIGINT[] AS numbers FROM (SELECT DISTINCT name FROM p)
  UNION ALL SELECT g.name, p.i, CASE WHEN list_contains(ids, p.id) OR list_contains(numbers, p.number) THEN ids ELSE list_append(ids, p.id) END,
    CASE WHEN list_contains(ids, p.id) OR list_contains(numbers, p.number) THEN numbers ELSE list_append(numbers, p.number) END FROM g JOIN p ON p.name = g.name AND p.i = g.i + 1),
m AS (SELECT unnest(ids) AS id, unnest(numbers) AS number FROM (SELECT arg_max(ids, i) AS ids, arg_max(numbers, i) AS numbers FROM g GROUP BY name)),
t AS (SELECT name, max(number) AS top FROM k GROUP BY name),
f AS (SELECT two.*, top, count(*) OVER (PARTITION BY two.name) AS left_n, row_number() OVER (PARTITION BY two.name ORDER BY service DESC, lat, lon, id) = 1 AND top IS NULL AS f
  FROM two LEFT JOIN t USING (name) WHERE id NOT IN (SELECT id FROM m) AND (top IS NOT NULL OR (SELECT count(*) FROM two z WHERE z.name = two.name) > 1)),
r AS (SELECT *, max(lat) OVER w - min(lat) OVER w AS high, max(lon) OVER w - min(lon) OVER w AS wide, (max(lat) OVER w + min(lat) OVER w) / 2 AS mid FROM f WINDOW w AS (PARTITION BY name, f)),
n AS (SELECT id, number FROM m UNION ALL SELECT id, coalesce(top, 0) + row_number() OVER (PARTITION BY name ORDER BY f DESC, CASE WHEN high >= wide * cos(radians(mid)) THEN lat ELSE lon END, id) FROM r)
SELECT two.id, two.name, CAST(coalesce(number, 0) AS INT) AS number FROM two LEFT JOIN n USING (id)"""))
def q36_kept(spark, d):
    """The numbers of all stations after two imports in a row: some came, some went, some moved."""
    c = spark.sql(_STATIONS, customer=table(spark, d, "customer"))
    none = spark.createDataFrame([], "name string, lat double, lon double, number int")
    _, entries = numbers.numbered(c.where("id % 7 <> 0"), none)
    return numbers.numbered(c.where("id % 5 <> 0").withColumn("lat", F.col("lat") + F.lit(0.0007) * (F.col("id") % 3)), entries)[0]


@query("q48_place_lookup", duck("SELECT CAST(floor(lat * 1e5 + 0.5e0) AS BIGINT) AS lat5, CAST(floor(lon * 1e5 + 0.5e0) AS BIGINT) AS lon5, min(station_id) AS station_id FROM {dv_stops} GROUP BY ALL"))
def q48(spark, d):
    return view(spark, d, "dv_stops").groupBy(geo.half_up(F.col("lat") * 1e5).alias("lat5"), geo.half_up(F.col("lon") * 1e5).alias("lon5")).agg(F.min("station_id").alias("station_id"))


@query("k06_minimal_columns", duck("SELECT mode, list(id ORDER BY id) AS ids, list(d ORDER BY id) AS dlat FROM (SELECT CASE WHEN stop_id % 2 = 0 THEN 'bus' ELSE 'tram' END AS mode, stop_id AS id, CAST(floor(lat * 1e5 + 0.5e0) AS BIGINT) - coalesce(lag(CAST(floor(lat * 1e5 + 0.5e0) AS BIGINT)) OVER (PARTITION BY stop_id % 2 ORDER BY stop_id), 0) AS d FROM {dv_stops}) GROUP BY mode"))
def k06(spark, d):
    s = view(spark, d, "dv_stops").select(F.when(F.col("stop_id") % 2 == 0, "bus").otherwise("tram").alias("mode"), F.col("stop_id").alias("id"), geo.half_up(F.col("lat") * 1e5).alias("v"))
    g = seq.delta(s, ["mode"], "id", "v").groupBy("mode").agg(F.array_sort(F.collect_list(F.struct("id", "delta"))).alias("l"))
    return g.select("mode", F.transform("l", lambda x: x["id"]).alias("ids"), F.transform("l", lambda x: x["delta"]).alias("dlat"))


@query("k05_json_rows", duck("SELECT stop_id, '{\"stop_id\":' || CAST(stop_id AS VARCHAR) || ',\"name\":\"' || name || '\"}' AS json FROM {dv_stops}"))
def k05(spark, d):
    return view(spark, d, "dv_stops").select("stop_id", F.to_json(F.struct("stop_id", "name")).alias("json"))


@query("f01_point_in_region", duck("SELECT a.stop_id AS stop_id, CAST(min(greatest(abs(floor(a.lat / 0.01) - floor(b.lat / 0.01)), abs(floor(a.lon / 0.015) - floor(b.lon / 0.015)))) AS BIGINT) AS distance FROM {dv_stops} a JOIN {dv_stops} b ON b.in_region GROUP BY a.stop_id HAVING distance <= 8"))
def f01(spark, d):
    s = view(spark, d, "dv_stops")
    cells = map_view.spread(map_view.cells(s.where("in_region")), 8)
    return map_view.cells(s, "stop_id").join(cells, ["row", "col"]).select("stop_id", "distance")


@query("f02_rasterise", duck("""
WITH o AS (SELECT town_id AS area, min(lat) - 0.0077 AS s, min(lon) - 0.0077 AS w, max(lat) + 0.0077 AS n, max(lon) + 0.0077 AS e FROM {dv_stops} GROUP BY town_id)
SELECT area, CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col FROM o, range(4880, 4930) AS x(r), range(700, 760) AS y(c)
WHERE (r + 0.5) * 0.01 >= s AND (r + 0.5) * 0.01 < n AND (c + 0.5) * 0.015 >= w AND (c + 0.5) * 0.015 < e"""))
def f02(spark, d):
    """The cells of the boxes of all towns."""
    return map_view.rasterise(boxes(view(spark, d, "dv_stops"), "town_id", 0.0077)).select("area", "row", "col")


@query("f03_spread", duck("SELECT CAST(floor(lat / 0.01) AS BIGINT) + dr AS row, CAST(floor(lon / 0.015) AS BIGINT) + dc AS col, min(greatest(abs(dr), abs(dc))) AS distance FROM {dv_stops}, (SELECT unnest(range(-2, 3)) AS dr), (SELECT unnest(range(-2, 3)) AS dc) GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1, 2")))
def f03(spark, d):
    return map_view.spread(map_view.cells(view(spark, d, "dv_stops")), 2)


@query("f05_coverage", duck("SELECT count(*) AS outside FROM (SELECT DISTINCT floor(lat / 0.01) AS r, floor(lon / 0.015) AS c FROM {dv_stops}) a WHERE NOT EXISTS (SELECT 1 FROM {dv_stops} b WHERE b.in_region AND abs(floor(b.lat / 0.01) - a.r) <= 3 AND abs(floor(b.lon / 0.015) - a.c) <= 3)"))
def f05(spark, d):
    s = view(spark, d, "dv_stops")
    covered = map_view.spread(map_view.cells(s.where("in_region")), 3)
    return map_view.cells(s).join(covered, ["row", "col"], "left_anti").agg(F.count(F.lit(1)).alias("outside"))


@query("j19_snap_candidates", duck("""
WITH e AS (SELECT DISTINCT from_id, to_id FROM {dv_hops}), g AS (SELECT from_id, to_id, a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2 FROM e JOIN {dv_stops} a ON a.stop_id = from_id JOIN {dv_stops} b ON b.stop_id = to_id WHERE from_id < to_id AND abs(a.lat - b.lat) < 0.03 AND abs(a.lon - b.lon) < 0.04),
p AS (SELECT stop_id AS id, lat + 0.003 AS y, lon + 0.003 AS x, cos(radians(lat + 0.003)) AS k FROM {dv_stops}),
q AS (SELECT *, least(1, greatest(0, ((x - x1) * k * (x2 - x1) * k + (y - y1) * (y2 - y1)) / (pow((x2 - x1) * k, 2) + pow(y2 - y1, 2)))) AS t FROM p, g),
m AS (SELECT id, from_id, to_id, round(sqrt(pow((x1 + t * (x2 - x1) - x) * k, 2) + pow(y1 + t * (y2 - y1) - y, 2)) * 111320, 3) AS metres FROM q)
SELECT id, from_id, to_id, metres FROM m WHERE metres <= 600 QUALIFY row_number() OVER (PARTITION BY id ORDER BY metres, from_id, to_id) <= 3"""))
def j19(spark, d):
    s = view(spark, d, "dv_stops")
    a = s.select(F.col("stop_id").alias("from_id"), F.col("lat").alias("y1"), F.col("lon").alias("x1"))
    b = s.select(F.col("stop_id").alias("to_id"), F.col("lat").alias("y2"), F.col("lon").alias("x2"))
    e = view(spark, d, "dv_hops").select("from_id", "to_id").distinct().where("from_id < to_id").join(a, "from_id").join(b, "to_id").where("abs(y1 - y2) < 0.03 AND abs(x1 - x2) < 0.04")
    p = s.select(F.col("stop_id").alias("id"), (F.col("lat") + 0.003).alias("y"), (F.col("lon") + 0.003).alias("x"))
    return map_view.snap(p, e, 600, 3).select("id", "from_id", "to_id", F.round("metres", 3).alias("metres"))


_GRID = """n AS (SELECT stop_id AS id FROM {dv_stops}), g AS (
  SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM {dv_hops} WHERE abs(from_id - to_id) IN (1, 5) AND NOT (abs(from_id - to_id) = 1 AND least(from_id, to_id) % 5 = 4)
), e AS (SELECT a, b, 1 + (a * 7 + b) % 4 AS w FROM g UNION ALL SELECT b, a, 1 + (a * 7 + b) % 4 FROM g)"""


@query("q30_cheapest_paths", duck(f"""
WITH RECURSIVE {_GRID}, p AS (
  SELECT 0 AS i, a AS start, a AS node, CAST(0 AS BIGINT) AS cost FROM (SELECT DISTINCT a FROM e)
  UNION ALL
  SELECT i + 1, start, node, min(cost) FROM (SELECT p.i, p.start, e.b AS node, p.cost + e.w AS cost FROM p JOIN e ON e.a = p.node) x WHERE i < 24 GROUP BY i, start, node
)
SELECT start AS from_id, node AS to_id, CAST(min(cost) AS DOUBLE) AS cost FROM p JOIN (SELECT DISTINCT least(from_id, to_id) AS start, greatest(from_id, to_id) AS node FROM {{dv_hops}}) USING (start, node)
GROUP BY ALL HAVING min(cost) <= 40"""))
def q30(spark, d):
    """The cheapest ways of all hops over those to neighbouring places of the map, by rounds of joins."""
    h = view(spark, d, "dv_hops").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()
    apart = F.col("b") - F.col("a")
    e = h.where((apart == 5) | ((apart == 1) & (F.col("a") % 5 != 4))).withColumn("w", 1 + (F.col("a") * 7 + F.col("b")) % 4)
    number = F.col("a") * 100 + F.col("b")
    at = [F.lit(0.0).alias(c) for c in ("x1", "y1", "x2", "y2")]
    one = e.select((number * 2).alias("arc"), number.alias("edge"), "a", "b", F.col("w").cast("double").alias("cost"), *at)
    two = e.select((number * 2 + 1).alias("arc"), number.alias("edge"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("w").cast("double").alias("cost"), *at)
    # a stop is at the end of each of its edges
    ends = e.select(F.col("a").alias("stop"), number.alias("edge"), F.lit(0.0).alias("t"), F.lit(0.0).alias("cost")).unionByName(
        e.select(F.col("b").alias("stop"), number.alias("edge"), F.lit(1.0).alias("t"), F.lit(0.0).alias("cost")))
    on = ends.select("stop").distinct()
    hops = h.select(F.col("a").alias("source"), F.col("b").alias("target")).join(on.withColumnRenamed("stop", "source"), "source", "left_semi").join(on.withColumnRenamed("stop", "target"), "target", "left_semi")
    hops = hops.select((F.col("source") * 100 + F.col("target")).alias("hop"), "source", "target", F.lit(40.0).alias("most"))
    found = routing.routes(hops, ends, one.unionByName(two)).where("reaches")
    return hops.join(found, "hop").select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), "cost")


_METRES = "sqrt(pow(({1}.lon - {0}.lon) * cos(radians(({0}.lat + {1}.lat) / 2)), 2) + pow({1}.lat - {0}.lat, 2)) * 111320"


@query("q32_segments", duck(f"""
WITH RECURSIVE g AS (SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM {{dv_hops}} WHERE abs(from_id - to_id) = 5 OR (abs(from_id - to_id) = 1 AND least(from_id, to_id) % 5 <> 4)),
e AS (SELECT u.stop_id AS a, v.stop_id AS b, (g.a * 7 + g.b) % 4 < 3 AS main, {_METRES.format('u', 'v')} AS w FROM g JOIN {{dv_stops}} u ON u.stop_id IN (g.a, g.b) JOIN {{dv_stops}} v ON v.stop_id IN (g.a, g.b) AND v.stop_id <> u.stop_id),
h AS (SELECT f.stop_id AS from_id, t.stop_id AS to_id, {_METRES.format('f', 't')} AS straight FROM (SELECT DISTINCT from_id, to_id FROM {{dv_hops}}) x JOIN {{dv_stops}} f ON f.stop_id = from_id JOIN {{dv_stops}} t ON t.stop_id = to_id),
n AS (SELECT u.stop_id AS a, v.stop_id AS b FROM {{dv_stops}} u, {{dv_stops}} v WHERE {_METRES.format('u', 'v')} <= 2500),
p AS (
  SELECT 0 AS i, from_id, to_id, straight, from_id AS node, 0e0 AS cost FROM h WHERE from_id % 3 <> 0
  UNION ALL
  SELECT i + 1, from_id, to_id, straight, node, min(cost) FROM (
    SELECT p.i, p.from_id, p.to_id, p.straight, e.b AS node, p.cost + e.w AS cost FROM p JOIN e ON e.a = p.node LEFT JOIN n s ON s.a = e.b AND s.b = p.from_id LEFT JOIN n t ON t.a = e.b AND t.b = p.to_id
    WHERE (p.straight <= 7000 OR e.main OR s.a IS NOT NULL OR t.a IS NOT NULL) AND p.cost + e.w <= 1.3e0 * p.straight) x
  WHERE i < 12 GROUP BY i, from_id, to_id, straight, node
), r AS (SELECT from_id, to_id, min(cost) AS cost FROM p WHERE node = to_id GROUP BY ALL)
SELECT 'road' AS net, h.from_id, h.to_id, CASE WHEN h.from_id % 3 = 0 AND (h.from_id + h.to_id) % 5 <> 0 THEN 'kept' WHEN cost IS NOT NULL THEN 'routed' ELSE 'straight' END AS state, round(coalesce(cost, straight), 3) AS metres, 1e0 AS share
FROM h LEFT JOIN r USING (from_id, to_id)"""))
def q32_segments(spark, d):
    """The ways of all hops, over those to neighbouring places of the map as the network; a third of the stops' ways are kept from before."""
    s = view(spark, d, "dv_stops")
    h = view(spark, d, "dv_hops").select(F.lit("road").alias("net"), "from_id", "to_id").distinct()
    apart = F.col("b") - F.col("a")
    g = h.select("net", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct().where((apart == 5) | ((apart == 1) & (F.col("a") % 5 != 4)))
    edges = g.select("net", (F.col("a") * 100 + F.col("b")).alias("edge"), "a", "b", F.lit(100).alias("cost"), F.lit(0).alias("direction"), ((F.col("a") * 7 + F.col("b")) % 4 < 3).alias("main"), F.lit(14).alias("speed"))
    nodes = s.select(F.col("stop_id").alias("id"), "lat", "lon")
    line = [s.select(F.col("stop_id").alias(c), F.struct("lat", "lon", F.lit(x).alias("share")).alias(f"p{x}")) for c, x in (("from_id", 0.0), ("to_id", 1.0))]
    kept = h.where("from_id % 3 = 0").join(line[0], "from_id").join(line[1], "to_id")
    kept = kept.select("net", "from_id", "to_id", F.when((F.col("from_id") + F.col("to_id")) % 5 != 0, F.array("`p0.0`", "`p1.0`")).alias("points"))
    found = segments.build(h, s, nodes, edges, kept, (1.3, 0.0), 5.0, 2.0, 7_000.0, 2_500.0)
    points = F.col("points")
    return found.select("net", "from_id", "to_id", "state", F.round(segments.metres_of(points), 3).alias("metres"), F.round(F.element_at(points, -1)["share"], 9).alias("share"))


_CALLS_AT = "SELECT st.station_id, t.line, t.agency, s.trip_id, s.pos, quarter(t.service_date) AS quarter, CAST(floor(s.dep_s / 60.0e0) AS BIGINT) AS m FROM {dv_stop_times} s JOIN {dv_stops} st USING (stop_id) JOIN {dv_trips} t USING (trip_id)"


def _calls_at(spark, d):
    s = view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops"), "stop_id").join(view(spark, d, "dv_trips"), "trip_id")
    return s.withColumns({"minute": F.floor(F.col("dep_s") / 60), "quarter": F.quarter("service_date"), "day": F.lit(0)})


@query("q21_line_facts", duck(frequency_sql.hourly(f"""SELECT line, station_id, 0 AS day, m FROM ({_CALLS_AT}) JOIN (
  SELECT line, station_id FROM ({_CALLS_AT}) GROUP BY line, station_id QUALIFY row_number() OVER (PARTITION BY line ORDER BY count(*) DESC, station_id) = 1) USING (line, station_id)""", ["line", "station_id"])))
def q21(spark, d):
    """Hourly words of each line's departures at its busiest station."""
    s = _calls_at(spark, d)
    top = ag.busiest(s.select("line", "station_id", F.col("station_id").alias("o")), ["line"], "station_id", "o")
    return frequency.hourly(s.join(top.select("line", "station_id"), ["line", "station_id"]), ["line", "station_id"], "day", "minute")


@query("q22_stop_hours", duck(frequency_sql.hourly(f"SELECT station_id, line, 0 AS day, m FROM ({_CALLS_AT})", ["station_id", "line"])))
def q22(spark, d):
    """Hourly words of each station and line."""
    return frequency.hourly(_calls_at(spark, d), ["station_id", "line"], "day", "minute")


@query("q23_described_stretch", duck(frequency_sql.stretches(f"SELECT agency, quarter AS day, m FROM ({_CALLS_AT})", ["agency"])))
def q23(spark, d):
    """The longest stretch of hours that one thing holds for on all days of an agency."""
    return frequency.stretches(frequency.hours(_calls_at(spark, d), ["agency"], "quarter", "minute"), ["agency"])


@query("q02_join_platforms", duck("""
WITH c AS (SELECT stop_id, count(*) AS n FROM {dv_stop_times} GROUP BY stop_id), s AS (SELECT st.stop_id, st.station_id, coalesce(n, 0) AS n FROM {dv_stops} st LEFT JOIN c ON c.stop_id = st.stop_id)
SELECT stop_id, first_value(stop_id) OVER (PARTITION BY station_id ORDER BY n DESC, stop_id) AS parent FROM s"""))
def q02(spark, d):
    c = view(spark, d, "dv_stop_times").groupBy("stop_id").agg(F.count(F.lit(1)).alias("n"))
    s = view(spark, d, "dv_stops").join(c, "stop_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    first = s.groupBy("station_id").agg(F.max_by("stop_id", F.struct("n", -F.col("stop_id"))).alias("parent"))
    return s.join(first, "station_id").select("stop_id", "parent")


@query("q03_assemble", duck("SELECT trip_id, row_number() OVER (ORDER BY first_line, trip_id) AS rank FROM (SELECT trip_id, min(dep_s) AS first_line FROM {dv_stop_times} GROUP BY trip_id)"))
def q03(spark, d):
    """Ranks of all trips in order: a range sort with prefix sums instead of one window over everything."""
    s = view(spark, d, "dv_stop_times").groupBy("trip_id").agg(F.min("dep_s").alias("k"))
    return map_view.global_rank(s, ["k", "trip_id"]).select("trip_id", "rank")
