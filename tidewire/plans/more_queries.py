"""Sources and sinks read back, addresses, lookups, paths and search helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, hashing, paths, realtime, text, ways
from ..operators import aggregates as ag
from ..operators import frequency, graph, joins, lines, map_view, search, tiles, towns, tracks, vehicles
from ..operators import sequences as seq
from ..operators.tables import materialise, shared_dir
from ..sources import files, gtfs
from ..sources.derived import bucketed, derived
from . import frequency_sql
from .registry import query
from .transit import duck, table, view


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_line_splitter", duck("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM {documents}"))
def s01(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", r"\r?\n")).cast("long").alias("lines"))


@query("s02_csv_record_parse", duck("SELECT c_custkey AS k, c_name || ', \"x\"' AS name, c_mktsegment AS segment FROM {customer}"))
def s02(spark, d):
    c = table(spark, d, "customer")
    name = F.concat("c_name", F.lit(', "x"'))
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('",'), "c_mktsegment")
    r = c.select(F.from_csv(line, "k BIGINT, name STRING, segment STRING", {"quote": '"', "escape": '"'}).alias("r"))
    return r.select("r.k", "r.name", "r.segment")


@query("s04_typed_table_scan", duck("SELECT CAST(n_nationkey AS VARCHAR) AS stop_id, n_name AS stop_name, '' AS platform_code FROM {nation}"))
def s04(spark, d):
    folder = _folder(spark, "feed")
    n = table(spark, d, "nation").select(F.concat_ws(",", "n_name", F.lit("11.0"), F.col("n_nationkey").cast("string"), F.lit("49.0")).alias("value"), F.lit(1).alias("o"))
    head = spark.createDataFrame([("stop_name,stop_lon,stop_id,stop_lat", 0)], "value string, o int")
    head.unionByName(n).coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{folder}/stops.txt")
    return gtfs.read_table(spark, folder, "stops").select("stop_id", "stop_name", "platform_code")


@query("s05_early_projection", duck("SELECT l_orderkey, count(*) AS n FROM {lineitem} WHERE l_quantity > 25 GROUP BY l_orderkey"))
def s05(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("s14_dataset_read_back", duck("SELECT * FROM {dv_stops}"))
def s14(spark, d):
    folder = _folder(spark, "dataset")
    files.write_dataset({"stops": view(spark, d, "dv_stops")}, folder, "box")
    return files.read_dataset(spark, folder, "box")["stops"]


@query("s15_head_only", duck("SELECT 1 AS version, 'box' AS scope, 'stops' AS name, (SELECT count(*) FROM {dv_stops}) AS rows UNION ALL SELECT 1, 'box', 'trips', (SELECT count(*) FROM {dv_trips})"))
def s15(spark, d):
    """What the head of a dataset says, with no table read."""
    folder = _folder(spark, "dataset")
    files.write_dataset({"stops": view(spark, d, "dv_stops"), "trips": view(spark, d, "dv_trips")}, folder, "box")
    return spark.read.parquet(f"{folder}/meta").select("version", "scope", F.explode("rows").alias("name", "rows"))


@query("s16_selected_columns", duck("SELECT doc_id, lang FROM {documents}"))
def s16(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@query("s21_gz_json_read_back", duck("SELECT event_id, event_type FROM {events}"))
def s21(spark, d):
    folder = _folder(spark, "json")
    files.write_json(table(spark, d, "events").select("event_id", "event_type"), folder)
    return spark.read.schema("event_id BIGINT, event_type STRING").json(folder)


@query("k03_log_compacted", duck("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM {events} WHERE user_id % 2 = 0 GROUP BY user_id"))
def k03(spark, d):
    log, new = _folder(spark, "log"), _folder(spark, "log")
    e = table(spark, d, "events").select("user_id", "value", "event_id", F.col("event_id").alias("version"))
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        files.append_log(e.where(part), log)
    files.compact_log(spark, log, new, ["user_id"], "version", e.where("user_id % 2 = 0"))
    return spark.read.parquet(new).select("user_id", "value", "event_id")


@query("k04_shared_borders_once", duck("SELECT DISTINCT least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM {dv_hops}"))
def k04(spark, d):
    return view(spark, d, "dv_hops").select(F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()


@query("f04_extent_of_hops", duck("""
WITH e AS (SELECT DISTINCT a.lat AS y1, a.lon AS x1, b.lat AS y2, b.lon AS x2 FROM {dv_hops} JOIN {dv_stops} a ON a.stop_id = from_id JOIN {dv_stops} b ON b.stop_id = to_id)
SELECT DISTINCT CAST(floor((y1 + (y2 - y1) * i / 20) / 0.01) AS BIGINT) AS row, CAST(floor((x1 + (x2 - x1) * i / 20) / 0.015) AS BIGINT) AS col FROM e, range(21) AS r(i)"""))
def f04(spark, d):
    s = view(spark, d, "dv_stops")
    a = s.select(F.col("stop_id").alias("from_id"), F.col("lat").alias("y1"), F.col("lon").alias("x1"))
    b = s.select(F.col("stop_id").alias("to_id"), F.col("lat").alias("y2"), F.col("lon").alias("x2"))
    e = view(spark, d, "dv_hops").select("from_id", "to_id").distinct().join(a, "from_id").join(b, "to_id").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(20))))
    at = lambda c: F.col(f"{c}1") + (F.col(f"{c}2") - F.col(f"{c}1")) * F.col("i") / 20
    return map_view.cells(e.select(at("y").alias("lat"), at("x").alias("lon")))


@query("o03_numeric_sort", duck("SELECT trip_id, pos, row_number() OVER (PARTITION BY stop_id ORDER BY dep_s, trip_id, pos) AS n FROM {dv_stop_times}"))
def o03(spark, d):
    w = Window.partitionBy("stop_id").orderBy("dep_s", "trip_id", "pos")
    return view(spark, d, "dv_stop_times").select("trip_id", "pos", F.row_number().over(w).alias("n"))


@query("o05_departure_tie_order", duck("SELECT trip_id, pos, row_number() OVER (PARTITION BY stop_id ORDER BY dep_s // 600, service_date, trip_id, pos) AS n FROM {dv_stop_times} JOIN {dv_trips} USING (trip_id)"))
def o05(spark, d):
    w = Window.partitionBy("stop_id").orderBy(F.floor(F.col("dep_s") / 600), "service_date", "trip_id", "pos")
    return view(spark, d, "dv_stop_times").join(view(spark, d, "dv_trips"), "trip_id").select("trip_id", "pos", F.row_number().over(w).alias("n"))


@query("o12_name_precedence", duck("SELECT trip_id, row_number() OVER (PARTITION BY line ORDER BY CASE WHEN trip_id % 50 = 0 THEN 4 WHEN mode = 'regional' THEN 2 ELSE 1 END DESC, trip_id) AS n FROM {dv_trips}"))
def o12(spark, d):
    weight = F.when(F.col("trip_id") % 50 == 0, 4).when(F.col("mode") == "regional", 2).otherwise(1)
    return view(spark, d, "dv_trips").select("trip_id", F.row_number().over(Window.partitionBy("line").orderBy(weight.desc(), "trip_id")).alias("n"))


@query("x06_towns_along", duck("SELECT s.trip_id, s.pos, CASE WHEN min(town_id) OVER (PARTITION BY s.trip_id) <> max(town_id) OVER (PARTITION BY s.trip_id) THEN town_id END AS town FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id"))
def x06(spark, d):
    s = view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops"), "stop_id")
    return lines.towns_along(s).select("trip_id", "pos", "town")


@query("x13_headsign_at", duck("SELECT s.trip_id, s.pos, CASE WHEN s.trip_id % 2 = 0 THEN 'via ' || CAST(s.pos AS VARCHAR) ELSE last_value(st.name) OVER (PARTITION BY s.trip_id ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS sign FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id"))
def x13(spark, d):
    s = view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops"), "stop_id")
    own = F.when(F.col("trip_id") % 2 == 0, F.concat(F.lit("via "), F.col("pos").cast("string")))
    return lines.headsigns(s, own, "name").select("trip_id", "pos", "sign")


@query("x19_language_pick", duck("SELECT lang, coalesce(min(doc_id) FILTER (WHERE source = 'src1'), min(doc_id)) AS doc_id FROM {documents} GROUP BY lang"))
def x19(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("source") == "src1", F.col("doc_id"))), F.min("doc_id")).alias("doc_id"))


@query("t06_day_of", duck("SELECT trip_id, CASE WHEN max(arr_s) - 86400 >= 3600 THEN DATE '2026-10-01' ELSE DATE '2026-10-02' END AS day FROM {dv_stop_times} GROUP BY trip_id"))
def t06(spark, d):
    from ..functions.time import day_of

    e = view(spark, d, "dv_stop_times").groupBy("trip_id").agg((F.max("arr_s") - 86_400).alias("e"))
    return e.select("trip_id", day_of(F.lit(3600), F.lit("2026-10-02").cast("date"), F.col("e")).alias("day"))


@query("m05_bearing", duck("SELECT a.stop_id AS one, b.stop_id AS two, CAST(floor(((degrees(atan2((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), b.lat - a.lat)) + 360) % 360) + 0.5e0) AS INT) AS bearing FROM {dv_stops} a JOIN {dv_stops} b ON a.stop_id < b.stop_id AND a.town_id = b.town_id"))
def m05(spark, d):
    s = view(spark, d, "dv_stops")
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.town_id") == F.col("b.town_id")) & (F.col("a.stop_id") < F.col("b.stop_id")))
    return j.select(F.col("a.stop_id").alias("one"), F.col("b.stop_id").alias("two"), geo.bearing(*[F.col(x) for x in ("a.lat", "a.lon", "b.lat", "b.lon")]).alias("bearing"))


def _line(spark, d):
    return view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops").select("stop_id", "lat", "lon"), "stop_id")


_STEP = "coalesce(sqrt(pow((lon - lag(lon) OVER w) * cos(radians((lag(lat) OVER w + lat) / 2)), 2) + pow(lat - lag(lat) OVER w, 2)) * 111320, 0)"


@query("m08_path_length", duck(f"SELECT trip_id, round(sum(step), 3) AS metres FROM (SELECT trip_id, {_STEP} AS step FROM {{dv_stop_times}} s JOIN {{dv_stops}} st ON st.stop_id = s.stop_id WINDOW w AS (PARTITION BY trip_id ORDER BY pos)) GROUP BY trip_id"))
def m08(spark, d):
    return paths.lengths(_line(spark, d), ["trip_id"], "pos").groupBy("trip_id").agg(F.round(F.sum("step"), 3).alias("metres"))


@query("m08_simplified_path", duck("""
WITH RECURSIVE c AS (SELECT s.trip_id, s.pos, st.lat, st.lon, cos(radians(first_value(st.lat) OVER (PARTITION BY s.trip_id ORDER BY s.pos))) AS k
  FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id),
v AS (SELECT a.trip_id, a.pos AS a, b.pos AS b, (b.lon - a.lon) * a.k AS ex, b.lat - a.lat AS ey, a.lon AS lon, a.lat AS lat, a.k FROM c a JOIN c b ON b.trip_id = a.trip_id AND b.pos > a.pos),
t AS (SELECT v.*, c.pos, (c.lon - v.lon) * v.k AS px, c.lat - v.lat AS py, ex * ex + ey * ey AS size FROM v JOIN c ON c.trip_id = v.trip_id AND c.pos > v.a AND c.pos < v.b),
u AS (SELECT *, CASE WHEN size > 0 THEN least(1, greatest(0, (px * ex + py * ey) / size)) ELSE 0 END AS s FROM t),
far AS (SELECT trip_id, a, b, max(d) AS d, min(pos) FILTER (d = top) AS at_pos FROM (
  SELECT *, max(d) OVER (PARTITION BY trip_id, a, b) AS top FROM (SELECT trip_id, a, b, pos, round(sqrt(pow(px - s * ex, 2) + pow(py - s * ey, 2)) * 111320, 6) AS d FROM u) x) y GROUP BY ALL),
r AS (
  SELECT trip_id, min(pos) AS a, max(pos) AS b FROM c GROUP BY trip_id
  UNION ALL
  SELECT trip_id, unnest([a, at_pos]), unnest([at_pos, b]) FROM (SELECT r.trip_id, r.a, r.b, at_pos FROM r JOIN far ON far.trip_id = r.trip_id AND far.a = r.a AND far.b = r.b WHERE far.d > 1.5) x
)
SELECT trip_id, list_sort(list_distinct(list_concat(list(a), list(b)))) AS kept FROM r GROUP BY trip_id"""))
def m08b(spark, d):
    p = _line(spark, d).groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("l"))
    at = lambda c: F.transform("l", lambda x: x[c])
    return p.select("trip_id", paths.simplified(at("lat"), at("lon")).alias("kept"))


@query("m09_timed_points", duck(f"""
WITH x AS (SELECT trip_id, pos, {_STEP} AS step, CASE WHEN pos % 2 = 1 THEN 10e0 + trip_id % 5 END AS v FROM {{dv_stop_times}} s JOIN {{dv_stops}} st ON st.stop_id = s.stop_id WINDOW w AS (PARTITION BY trip_id ORDER BY pos)),
y AS (SELECT *, step / coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING), first_value(v IGNORE NULLS) OVER (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS t FROM x)
SELECT trip_id, pos, round(CASE WHEN sum(t) OVER (PARTITION BY trip_id) > 0 THEN sum(t) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) / sum(t) OVER (PARTITION BY trip_id) ELSE 0 END, 9) AS share FROM y"""))
def m09(spark, d):
    p = _line(spark, d).withColumn("v", F.when(F.col("pos") % 2 == 1, F.lit(10.0) + F.col("trip_id") % 5))
    return paths.time_shares(p, ["trip_id"], "pos", "v").select("trip_id", "pos", F.round("share", 9).alias("share"))


@query("m10_step_cutting", duck("""
WITH x AS (SELECT trip_id, pos, CAST(dep_s AS BIGINT) AS v, lag(CAST(dep_s AS BIGINT)) OVER (PARTITION BY trip_id ORDER BY pos) AS p FROM {dv_stop_times}),
y AS (SELECT *, CAST(greatest(1, ceil(abs(v - coalesce(p, v)) / 1000.0e0)) AS BIGINT) AS n FROM x)
SELECT trip_id, pos, CAST(i AS INT) AS piece, CASE WHEN p IS NULL OR i = n THEN v ELSE CAST(floor(p + (v - p) * i / CAST(n AS DOUBLE) + 0.5e0) AS BIGINT) END AS v FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM y)"""))
def m10(spark, d):
    p = view(spark, d, "dv_stop_times").select("trip_id", "pos", F.col("dep_s").cast("long").alias("v"))
    return paths.cut_steps(p, ["trip_id"], "pos", "v", 1000).select("trip_id", "pos", "piece", "v")


def _literal(values: list[dict[str, str]]):
    none = F.create_map().cast("map<string,string>")
    return F.array(*[F.create_map(*[F.lit(x) for kv in v.items() for x in kv]) if v else none for v in values])


#: tags and the limit in km/h that they say
LIMITS = [
    ({"maxspeed": "50"}, 50.0), ({"maxspeed": "100 mph"}, 160.9), ({"maxspeed": "DE:urban"}, 50.0), ({"maxspeed": "DE:rural"}, 100.0), ({"maxspeed": "none"}, 130.0),
    ({"maxspeed": "walk"}, 7.0), ({"maxspeed:forward": "70"}, 70.0), ({"maxspeed:backward": "30"}, 30.0), ({"maxspeed": "signals"}, None), ({}, None), ({"maxspeed": "60; 50"}, 60.0),
]
_LIMITS = ", ".join(f"({i}, {'NULL' if v is None else f'{v}e0'})" for i, (_, v) in enumerate(LIMITS))


@query("m11_max_speed", duck(f"SELECT p_partkey, kmh FROM {{part}} JOIN (VALUES {_LIMITS}) AS t(i, kmh) ON i = p_partkey % {len(LIMITS)}"))
def m11(spark, d):
    tags = F.element_at(_literal([t for t, _ in LIMITS]), (F.col("p_partkey") % len(LIMITS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.round(ways.maxspeed(tags), 6).alias("kmh"))


@query("m12_lite_two_moments", duck("""
WITH k AS (SELECT s.trip_id, s.pos, CAST(s.dep_s AS DOUBLE) AS t, st.lat FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id),
n AS (SELECT *, lead(t) OVER w AS u, lead(lat) OVER w AS lat2, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY trip_id ORDER BY t, pos)), m AS (SELECT unnest([30000e0, 30060e0]) AS now),
h AS (SELECT *, CASE WHEN now < t OR u IS NULL OR u = t THEN 0e0 ELSE (now - t) / (u - t) END AS f FROM n, m WHERE (t <= now AND (now < u OR u IS NULL)) OR (n = 1 AND now < t))
SELECT trip_id, CAST(now AS BIGINT) AS now, round(lat + CASE WHEN f = 0 THEN 0 ELSE (lat2 - lat) * f END, 9) AS lat FROM h"""))
def m12(spark, d):
    k = _line(spark, d).select("trip_id", "pos", (F.col("dep_s") * 1.0).alias("t"), "lat")
    moments = F.array(*[F.lit(float(now)) for now in (30_000, 30_060)])
    p = seq.position_at(k, ["trip_id"], "t", moments, ["lat"], "pos", at="now")
    return p.select("trip_id", F.col("now").cast("long").alias("now"), F.round("lat", 9).alias("lat"))


@query("m13_delay_class", duck("SELECT event_id, CASE WHEN delay IS NULL THEN 'none' WHEN floor(delay / 60.0e0 + 0.5e0) < 2 THEN 'ok' WHEN floor(delay / 60.0e0 + 0.5e0) < 5 THEN 'minor' WHEN floor(delay / 60.0e0 + 0.5e0) < 10 THEN 'major' ELSE 'severe' END AS class FROM {dv_updates}"))
def m13(spark, d):
    return view(spark, d, "dv_updates").select("event_id", realtime.delay_class(F.col("delay")).alias("class"))


@query("r01_array_functions", duck("SELECT trip_id, list_filter(l, lambda x: x % 2 = 0) AS even, list_position(l, 3) AS at, len(l) AS n FROM (SELECT trip_id, list(stop_id ORDER BY pos) AS l FROM {dv_stop_times} GROUP BY trip_id)"))
def r01(spark, d):
    l = view(spark, d, "dv_stop_times").groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_id"))), lambda x: x["stop_id"]).alias("l"))
    at = F.array_position("l", F.lit(3))
    return l.select("trip_id", F.filter("l", lambda x: x % 2 == 0).alias("even"), F.when(at > 0, at).alias("at"), F.size("l").alias("n"))


#: tags and what they say: network, cost in per cent, direction, networks it is shared with, main road, half the km/h
WAYS = [
    ({"highway": "primary"}, ("road", 100, 0, "", True, 15)), ({"highway": "primary", "maxspeed": "70"}, ("road", 100, 0, "", True, 28)),
    ({"highway": "primary", "maxspeed": "100"}, ("road", 100, 0, "", True, 40)), ({"highway": "motorway"}, ("road", 100, 1, "", True, 50)),
    ({"highway": "motorway_link"}, ("road", 100, 0, "", True, 50)), ({"highway": "trunk", "maxspeed": "120"}, ("road", 100, 0, "", True, 50)),
    ({"highway": "motorway", "maxspeed": "none", "oneway": "maybe"}, ("road", 100, 0, "", True, 50)),
    ({"highway": "unclassified"}, ("road", 115, 0, "", False, 12)), ({"highway": "residential", "oneway": "yes"}, ("road", 130, 1, "", False, 9)),
    ({"highway": "residential", "oneway": "-1"}, ("road", 130, -1, "", False, 9)), ({"highway": "residential", "oneway": "yes", "oneway:bus": "no"}, ("road", 130, 0, "", False, 9)),
    ({"highway": "tertiary", "junction": "roundabout"}, ("road", 100, 1, "", False, 15)), ({"highway": "secondary_link"}, ("road", 100, 0, "", False, 15)),
    ({"highway": "service"}, ("road", 160, 0, "", False, 6)), ({"highway": "service", "access": "private"}, None),
    ({"highway": "service", "access": "private", "bus": "yes"}, ("road", 100, 0, "", False, 6)), ({"highway": "service", "service": "parking_aisle"}, None),
    ({"highway": "service", "access": "private", "vehicle": "yes"}, ("road", 160, 0, "", False, 6)), ({"highway": "tertiary", "motor_vehicle": "forestry"}, None),
    ({"highway": "living_street"}, ("road", 200, 0, "", False, 3)), ({"highway": "pedestrian"}, None), ({"highway": "pedestrian", "psv": "yes"}, ("road", 100, 0, "", False, 3)),
    ({"highway": "footway"}, None), ({"highway": "primary", "area": "yes"}, None), ({"route": "ferry"}, ("ferry", 100, 0, "", False, 10)),
    ({"railway": "rail"}, ("rail", 100, 0, "", False, 50)), ({"railway": "rail", "oneway": "yes", "maxspeed": "300"}, ("rail", 100, 0, "", False, 150)),
    ({"railway": "rail", "service": "yard"}, ("rail", 300, 0, "", False, 50)), ({"railway": "rail", "service": "siding", "rack": "no"}, ("rail", 150, 0, "", False, 50)),
    ({"railway": "tram", "oneway": "yes"}, ("tram", 100, 1, "subway,rail", False, 20)), ({"railway": "subway"}, ("subway", 100, 0, "tram", False, 30)),
    ({"railway": "light_rail"}, ("rail", 100, 0, "subway,tram", False, 35)), ({"railway": "abandoned"}, None), ({"railway": "monorail", "service": "yard"}, ("cable", 300, 0, "", False, 20)),
    ({"railway": "narrow_gauge"}, ("cable", 100, 0, "rail", False, 20)), ({"railway": "narrow_gauge", "rack": "abt"}, ("cable", 100, 0, "", False, 20)),
    ({"railway": "tram", "rack": "riggenbach"}, ("cable", 100, 0, "", False, 20)), ({"aerialway": "gondola"}, ("cable", 100, 0, "", False, 10)), ({"aerialway": "drag_lift"}, None),
]
_WAYS = ", ".join(f"({i}, '{w[0]}', {w[1]}, {w[2]}, '{w[3]}', {w[4]}, {w[5]})" for i, (_, w) in enumerate(WAYS) if w)


@query("r04_classify_ways", duck(f"""
SELECT p_partkey, net, cost, direction, shared, main, speed FROM {{part}} LEFT JOIN (VALUES {_WAYS}) AS t(i, net, cost, direction, shared, main, speed) ON i = p_partkey % {len(WAYS)}"""))
def r04(spark, d):
    tags = F.element_at(_literal([t for t, _ in WAYS]), (F.col("p_partkey") % len(WAYS) + 1).cast("int"))
    w = table(spark, d, "part").select("p_partkey", ways.classify(tags).alias("w"))
    return w.select("p_partkey", "w.net", F.round(F.col("w.factor") * 100).cast("int").alias("cost"), "w.direction", F.concat_ws(",", "w.shared").alias("_s"), "w.main", "w.speed").select(
        "p_partkey", "net", "cost", "direction", F.when(F.col("net").isNotNull(), F.col("_s")).alias("shared"), "main", "speed")


@query("q11_leaving_with_delays", duck("""
SELECT s.trip_id, s.pos, s.dep_s + coalesce(u.delay, 0) AS expected FROM {dv_stop_times} s LEFT JOIN {dv_updates} u ON u.trip_id = s.trip_id AND u.pos = s.pos
WHERE s.dep_s BETWEEN 36000 - 10800 AND 43200 AND s.dep_s + coalesce(u.delay, 0) BETWEEN 36000 - 30 AND 43200"""))
def q11(spark, d):
    u = view(spark, d, "dv_updates").select("trip_id", F.col("pos").cast("int").alias("pos"), "delay")
    s = view(spark, d, "dv_stop_times").where("dep_s BETWEEN 25200 AND 43200").join(u, ["trip_id", "pos"], "left")
    return s.select("trip_id", "pos", (F.col("dep_s") + F.coalesce("delay", F.lit(0))).alias("expected")).where("expected BETWEEN 35970 AND 43200")


@query("q27_kinds_from_tracks", duck("""
WITH c AS (SELECT DISTINCT agency * 10 + stop_id % 3 AS route, stop_id FROM {dv_stop_times} JOIN {dv_trips} USING (trip_id) WHERE mode = 'tram'),
s AS (SELECT route, avg(CASE WHEN stop_id % 5 IN (1, 2) THEN 1e0 ELSE 0e0 END) AS part FROM c WHERE stop_id % 7 <> 3 GROUP BY route)
SELECT route, coalesce(part < 0.6, false) AS is_bus FROM (SELECT DISTINCT route FROM c) LEFT JOIN s USING (route)"""))
def q27(spark, d):
    """Tracks run along two of the five rows of stops; roads reach all stops but every seventh."""
    stops = view(spark, d, "dv_stops").select("stop_id", "lat", "lon")
    calls = view(spark, d, "dv_stop_times").join(view(spark, d, "dv_trips").where("mode = 'tram'"), "trip_id")
    calls = calls.select((F.col("agency") * 10 + F.col("stop_id") % 3).alias("route"), "stop_id").distinct()
    row = stops.where("stop_id % 5 IN (1, 2)").groupBy("lat").agg(F.min("lon").alias("lon1"), F.max("lon").alias("lon2"), F.min("stop_id").alias("edge"))
    rails = row.select("edge", (F.col("lat") + 0.0001).alias("lat1"), "lon1", (F.col("lat") + 0.0001).alias("lat2"), "lon2")
    return tracks.kinds_from_tracks(calls, stops, stops.where("stop_id % 7 <> 3"), rails)


@query("q29_tiles", duck("SELECT stop_id, CAST(floor(lat / 0.05) AS BIGINT) + dy AS ty, CAST(floor(lon / 0.05) AS BIGINT) + dx AS tx FROM {dv_stops}, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)"))
def q29(spark, d):
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    s = view(spark, d, "dv_stops").withColumn("dy", F.explode(near)).withColumn("dx", F.explode(near))
    return s.select("stop_id", (F.floor(F.col("lat") / 0.05) + F.col("dy")).alias("ty"), (F.floor(F.col("lon") / 0.05) + F.col("dx")).alias("tx"))


#: edges between stops that are hops of the timetable, the stops of each part, and the parts' edges
_PARTS = """
WITH n AS (SELECT stop_id AS id, CAST(floor(lat / 0.025e0) AS BIGINT) AS hy, CAST(floor(lon / 0.025e0) AS BIGINT) AS hx FROM {dv_stops}),
e AS (SELECT DISTINCT CAST(from_id AS BIGINT) AS a, CAST(to_id AS BIGINT) AS b FROM {dv_hops}),
t AS (SELECT DISTINCT hy + dy AS ty, hx + dx AS tx FROM n, (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx)),
w AS (SELECT ty, tx, id, hy = ty AND hx = tx AS home FROM t JOIN n ON abs(hy - ty) <= 1 AND abs(hx - tx) <= 1),
p AS (SELECT DISTINCT ty, tx, a, b FROM (SELECT ty, tx, a, b FROM e JOIN w ON w.id = e.a UNION ALL SELECT ty, tx, a, b FROM e JOIN w ON w.id = e.b))
"""


def _parts(spark, d):
    nodes = view(spark, d, "dv_stops").select(F.col("stop_id").cast("long").alias("id"), "lat", "lon")
    edges = view(spark, d, "dv_hops").select(F.col("from_id").cast("long").alias("a"), F.col("to_id").cast("long").alias("b")).distinct()
    return tiles.parts(nodes, edges, 0.025)


@query("q29_part_edges", duck(f"{_PARTS} SELECT ty, tx, a, b FROM p"))
def q29_part_edges(spark, d):
    return _parts(spark, d)[1]


@query("q29_part_nodes", duck(f"""{_PARTS} SELECT ty, tx, id, home, FALSE AS border FROM w UNION ALL
SELECT DISTINCT ty, tx, id, FALSE, TRUE FROM (SELECT ty, tx, a AS id FROM p UNION ALL SELECT ty, tx, b FROM p) m
WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.ty = m.ty AND w.tx = m.tx AND w.id = m.id)"""))
def q29_part_nodes(spark, d):
    return _parts(spark, d)[0].select("ty", "tx", "id", "home", "border")


#: areas as boxes: number, level, name, south, west, north, east; the last one's border is not whole
BOXES = [
    (1, 6, "District", 48.99, 10.89, 49.07, 11.0), (2, 8, "Town", 49.01, 10.92, 49.05, 10.97), (3, 8, "Village", 48.99, 10.89, 49.01, 10.92), (4, 6, "City", 48.99, 11.0, 49.09, 11.03),
    (5, 4, "State", 48.9, 10.8, 49.2, 11.2), (6, 9, "Quarter", 49.0, 10.99, 49.1, 11.0), (7, 8, "Torn", 49.05, 10.89, 49.07, 10.92),
]
_IN = " WHEN ".join(f"lat >= {s}e0 AND lat < {n}e0 AND lon >= {w}e0 AND lon < {e}e0 THEN {k}" for k, level, _, s, w, n, e in sorted(BOXES, key=lambda b: -b[1]) if k in (2, 3, 4))


@query("q33_towns_of_stations", duck(f"""
SELECT stop_id, t.area, t.name, t.district FROM (SELECT stop_id, CASE WHEN {_IN} END AS area FROM {{dv_stops}}) s
JOIN (VALUES (2, 'Town', 'District'), (3, 'Village', 'District'), (4, 'City', NULL)) AS t(area, name, district) ON t.area = s.area"""))
def q33(spark, d):
    """Municipalities and a district without any are towns; the district and the state around them are none."""
    areas = spark.createDataFrame([b[:3] for b in BOXES], "area int, level int, name string")
    sides = [(k, *p, *q) for k, _, _, s, w, n, e in BOXES for p, q in (((s, w), (n, w)), ((n, w), (n, e)), ((n, e), (s, e)), ((s, e), (s, w)))]
    edges = spark.createDataFrame(sides[:-1], "area int, lat1 double, lon1 double, lat2 double, lon2 double")
    found = materialise(towns.among(areas, edges), "towns")
    at = towns.of_stations(view(spark, d, "dv_stops"), "stop_id", found, edges)
    return at.join(found, "area").select("stop_id", "area", "name", "district")


@query("q32_fresh_hops_routed", duck("SELECT DISTINCT from_id, to_id FROM {dv_hops} EXCEPT SELECT from_id, to_id FROM {dv_hops} WHERE trip_id % 2 = 0"))
def q32(spark, d):
    h = view(spark, d, "dv_hops")
    kept = materialise(h.where("trip_id % 2 = 0").select("from_id", "to_id").distinct(), "kept")
    return h.select("from_id", "to_id").distinct().join(kept, ["from_id", "to_id"], "left_anti")


def _screens(spark, d):
    """Customers as vehicles on small screens, some of them standing."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.floor(F.col("c_custkey") / 400).alias("screen"), hashing.mix(F.col("c_custkey")).alias("m"))
    return c.select("screen", "id", (F.col("m") % 120 * 1.0).alias("x"), (F.floor(F.col("m") / 1000) % 80 * 1.0).alias("y"),
                    F.when(F.col("m") % 7 > 0, F.col("m") % 63 / 10.0).alias("heading"), F.when(F.col("m") % 5 == 0, F.col("id") - 1).alias("near"))


@query("q42_vehicles_together")
def q42(spark, d):
    """Tested on the tables against a plain version."""
    return vehicles.together(_screens(spark, d), ["screen"])


@query("q47_line_paths", duck("SELECT DISTINCT 'line/' || CAST(agency AS VARCHAR) || '/' || mode || '/' || regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g') AS path FROM {dv_trips}"))
def q47(spark, d):
    return view(spark, d, "dv_trips").select(text.line_path(F.col("agency").cast("string"), F.col("mode"), F.col("line")).alias("path")).distinct()


@query("g06_rejected_updates", duck("""
WITH u AS (SELECT trip_id, CAST(pos AS INT) AS pos, CAST(event_id % 25 AS INT) AS stop_id FROM {dv_updates})
SELECT DISTINCT u.trip_id FROM u JOIN {dv_stop_times} s ON s.trip_id = u.trip_id AND s.pos = u.pos WHERE s.stop_id <> u.stop_id"""))
def g06(spark, d):
    u = view(spark, d, "dv_updates").select("trip_id", F.col("pos").cast("int").alias("pos"), (F.col("event_id") % 25).cast("int").alias("stop_id"), F.lit(1).alias("x"))
    good = joins.reject_mismatched(u, view(spark, d, "dv_stop_times"), "trip_id", ["pos"], "stop_id")
    return u.join(good.select("trip_id").distinct(), "trip_id", "left_anti").select("trip_id").distinct()


@query("v03_word_forms", duck("SELECT p_partkey, CASE WHEN starts_with(w, 'hauptbahnhof') OR starts_with(w, 'hbf') THEN 0 END AS level FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'hauptbahnhof' ELSE 'hbf' END AS w FROM {part})"))
def v03(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, "hauptbahnhof").otherwise("hbf").alias("w"))
    return p.select("p_partkey", search.level_of(F.col("w"), "hbf").alias("level"))


@query("v05_signs_per_stop", duck("SELECT p_partkey, max(CASE WHEN ends_with(w, 't') THEN 1 ELSE 0 END) | max(CASE WHEN w IN ('hot', 'red') THEN 2 ELSE 0 END) AS signs FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM {part}) GROUP BY p_partkey"))
def v05(spark, d):
    w = search.tokens(table(spark, d, "part"), "p_partkey", "p_name")
    sign = F.when(F.col("word").endswith("t"), 1).otherwise(0).bitwiseOR(F.when(F.col("word").isin("hot", "red"), 2).otherwise(0))
    return w.groupBy("p_partkey").agg(F.bit_or(sign).alias("signs"))


@query("v09_result_order", duck("SELECT p_partkey, row_number() OVER (ORDER BY p_size % 3, p_retailprice DESC, p_name, p_partkey) AS n FROM {part} QUALIFY n <= 50"))
def v09(spark, d):
    p = table(spark, d, "part").orderBy(F.col("p_size") % 3, F.desc("p_retailprice"), "p_name", "p_partkey").limit(50)
    return p.select("p_partkey", F.row_number().over(Window.orderBy(F.col("p_size") % 3, F.desc("p_retailprice"), "p_name", "p_partkey")).alias("n"))


@query("v11_chosen_ways", duck("SELECT DISTINCT mode, agency FROM {dv_trips} WHERE mode = 'bus' OR (mode = 'tram' AND agency = 2)"))
def v11(spark, d):
    keys = F.array(F.lit("bus/x"), F.lit("tram/x~2"))
    return view(spark, d, "dv_trips").select("mode", "agency").distinct().where(text.in_choice(keys, F.col("mode"), F.lit("x"), F.col("agency").cast("string")))


@query("v12_same_line", duck("SELECT a.trip_id FROM {dv_trips} a WHERE EXISTS (SELECT 1 FROM {dv_trips} b WHERE b.trip_id % 100 = 1 AND b.line = a.line AND b.mode = a.mode AND b.agency = a.agency)"))
def v12(spark, d):
    t = view(spark, d, "dv_trips")
    fav = t.where("trip_id % 100 = 1").select("line", "mode", "agency").distinct()
    return t.join(fav, ["line", "mode", "agency"], "left_semi").select("trip_id")


@query("v14_realtime_lookup", duck("SELECT s.trip_id, s.pos, u.delay FROM {dv_stop_times} s JOIN {dv_updates} u ON u.trip_id = s.trip_id AND u.pos = s.pos WHERE u.delay IS NOT NULL"))
def v14(spark, d):
    u = view(spark, d, "dv_updates").where("delay IS NOT NULL").select("trip_id", F.col("pos").cast("int").alias("pos"), "delay")
    return view(spark, d, "dv_stop_times").join(u, ["trip_id", "pos"]).select("trip_id", "pos", "delay")


@query("v16_delays_by_date", duck("SELECT CAST(ts AS DATE) AS day, event_id, delay FROM {dv_updates} WHERE delay IS NOT NULL"))
def v16(spark, d):
    """Known delays under their dates: rows, as a date's delays have no bound."""
    return view(spark, d, "dv_updates").where("delay IS NOT NULL").select(F.col("ts").cast("date").alias("day"), "event_id", "delay")


@query("v17_scheduled_times", duck("SELECT trip_id, pos, arr_s, dep_s FROM {dv_stop_times}"))
def v17(spark, d):
    """Times rebuilt from a start and a dictionary of running times."""
    s = view(spark, d, "dv_stop_times")
    start = F.first("dep_s").over(Window.partitionBy("trip_id").orderBy("pos"))
    rel = s.withColumn("start", start).select("trip_id", "pos", "start", (F.col("arr_s") - F.col("start")).alias("a"), (F.col("dep_s") - F.col("start")).alias("b"))
    book, members = seq.dictionary_encode(rel, "trip_id", "pos", ["a", "b"])
    trips = members.join(rel.where("pos = 0").select("trip_id", "start"), "trip_id")
    t = trips.join(book, "id").select("trip_id", "start", F.posexplode("list").alias("pos", "v"))
    return t.select("trip_id", "pos", (F.col("start") + F.col("v.a")).alias("arr_s"), (F.col("start") + F.col("v.b")).alias("dep_s"))


@query("v18_geometry_walk", duck(f"SELECT trip_id, pos, round(sum(step) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 3) AS along FROM (SELECT trip_id, pos, {_STEP} AS step FROM {{dv_stop_times}} s JOIN {{dv_stops}} st ON st.stop_id = s.stop_id WINDOW w AS (PARTITION BY trip_id ORDER BY pos))"))
def v18(spark, d):
    return paths.lengths(_line(spark, d), ["trip_id"], "pos").select("trip_id", "pos", F.round("along", 3).alias("along"))


@query("v19_way_key", duck("SELECT mode, from_id, to_id, from_dep, to_arr, count(*) AS n FROM {dv_hops} JOIN {dv_trips} USING (trip_id) GROUP BY ALL"))
def v19(spark, d):
    return view(spark, d, "dv_hops").join(view(spark, d, "dv_trips"), "trip_id").groupBy("mode", "from_id", "to_id", "from_dep", "to_arr").agg(F.count(F.lit(1)).alias("n"))


@query("v23_leavings_once_a_station", duck("SELECT s.trip_id, st.station_id, min(s.dep_s) AS dep_s FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id GROUP BY ALL"))
def v23(spark, d):
    return view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops"), "stop_id").groupBy("trip_id", "station_id").agg(F.min("dep_s").alias("dep_s"))


@query("v25_station_naming", duck("""
WITH c AS (SELECT stop_id, count(*) // 1000 AS c FROM {dv_stop_times} GROUP BY stop_id)
SELECT town_id, stop_id FROM {dv_stops} JOIN c USING (stop_id) QUALIFY row_number() OVER (PARTITION BY town_id ORDER BY c DESC, lat, lon, stop_id) = 1"""))
def v25(spark, d):
    """The station that an address means, service counted in thousands so that ties occur."""
    c = view(spark, d, "dv_stop_times").groupBy("stop_id").agg(F.floor(F.count(F.lit(1)) / 1000).alias("c"))
    return lines.first_of_name(view(spark, d, "dv_stops").join(c, "stop_id"), "town_id", "stop_id", "c", "lat", "lon")


@query("v26_line_places", duck("""
WITH l AS (SELECT c_custkey AS k, c_nationkey * 3 + CAST(floor(c_acctbal) AS BIGINT) % 3 AS address, c_custkey % 40 * 0.0043e0 + 49 AS lat, c_custkey % 11 * 0.0251e0 + 11 AS lon FROM {customer}),
w AS (SELECT *, printf('%.2f,%.2f', lat, lon) AS two, printf('%.4f,%.4f', lat, lon) AS four FROM l)
SELECT k, CASE WHEN count(*) OVER (PARTITION BY address) > 1 THEN CASE WHEN count(DISTINCT two) OVER (PARTITION BY address) = count(*) OVER (PARTITION BY address) THEN two ELSE four END END AS place FROM w"""))
def v26(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("k"), (F.col("c_nationkey") * 3 + F.floor("c_acctbal") % 3).alias("address"),
        (F.col("c_custkey") % 40 * F.lit(0.0043) + 49).alias("lat"), (F.col("c_custkey") % 11 * F.lit(0.0251) + 11).alias("lon"))
    return lines.places(c, "address", "lat", "lon").select("k", "place")


@query("v27_trips_by_line", duck("SELECT line, trip_id, row_number() OVER (PARTITION BY line ORDER BY trip_id) - 1 AS at FROM {dv_trips}"))
def v27(spark, d):
    """The trips of each line by their places in its list, for lines of any size."""
    return map_view.rank_in_groups(view(spark, d, "dv_trips").select("line", "trip_id"), "line", ["trip_id"]).select("line", "trip_id", "at")


@query("v31_kept_route_states", duck("WITH k AS (SELECT from_id, to_id, min(CASE WHEN trip_id % 3 = 0 THEN to_arr - from_dep END) AS s FROM {dv_hops} WHERE trip_id % 2 = 0 GROUP BY ALL), h AS (SELECT DISTINCT from_id, to_id FROM {dv_hops}) SELECT h.from_id, h.to_id, CASE WHEN k.from_id IS NULL THEN 'fresh' WHEN s IS NULL THEN 'none' ELSE 'kept' END AS state FROM h LEFT JOIN k ON k.from_id = h.from_id AND k.to_id = h.to_id"))
def v31(spark, d):
    h = view(spark, d, "dv_hops")
    k = h.where("trip_id % 2 = 0").groupBy("from_id", "to_id").agg(F.min(F.when(F.col("trip_id") % 3 == 0, F.col("to_arr") - F.col("from_dep"))).alias("s")).withColumn("known", F.lit(True))
    state = F.when(F.col("known").isNull(), "fresh").when(F.col("s").isNull(), "none").otherwise("kept")
    return h.select("from_id", "to_id").distinct().join(k, ["from_id", "to_id"], "left").select("from_id", "to_id", state.alias("state"))


_TODAY = "SELECT agency, line, 0 AS day, CAST(floor(dep_s / 60.0e0) AS BIGINT) AS m FROM {dv_stop_times} JOIN {dv_trips} USING (trip_id) WHERE pos = 0 AND dep_s < 50000 + agency * 5000"


@query("v36_today_said", duck(frequency_sql.hourly(_TODAY, ["agency", "line"]).replace("SELECT * FROM words", """
, t AS (SELECT agency, line, min(m) AS first, max(m) AS last FROM d GROUP BY ALL), n AS (SELECT *, 600 + agency * 60 AS now FROM t)
SELECT n.agency, n.line, CASE WHEN now > last THEN 'over' WHEN now < first THEN 'first' ELSE 'now' END AS said, w.kind, w.low, w.high, w."to" AS until, last
FROM n LEFT JOIN words w ON w.agency = n.agency AND w.line = n.line AND now BETWEEN first AND last AND w."from" * 60 <= now AND now < w."to" * 60""")))
def v36(spark, d):
    """What is said of the hour it is, of each line of an agency: its words, until when they hold, and the last departure."""
    t = view(spark, d, "dv_stop_times").where("pos = 0").join(view(spark, d, "dv_trips"), "trip_id").where("dep_s < 50000 + agency * 5000")
    t = t.select("agency", "line", F.floor(F.col("dep_s") / 60).alias("minute"), F.lit(0).alias("day"))
    by, now = ["agency", "line"], 600 + F.col("agency") * 60
    n = t.groupBy(*by).agg(F.min("minute").alias("first"), F.max("minute").alias("last"))
    said = lines.today_said(now, F.col("first"), F.col("last"))
    runs = frequency.hourly(t, by, "day", "minute").withColumnsRenamed({"agency": "_a", "line": "_l"})
    here = (F.col("_a") == F.col("agency")) & (F.col("_l") == F.col("line")) & now.between(F.col("first"), F.col("last"))
    here &= (F.col("from") * 60 <= now) & (now < F.col("to") * 60)
    return n.join(runs, here, "left").select("agency", "line", said.alias("said"), "kind", "low", "high", F.col("to").alias("until"), "last")


@query("v36_day_holds", duck("""
SELECT event_id, CAST(ts AS DATE) <= DATE '2024-01-10' OR (CAST(ts AS DATE) = DATE '2024-01-11' AND value IS NOT NULL AND value <= 50) AS holds FROM {events}"""))
def v36b(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", lines.day_holds(F.col("ts").cast("date"), F.lit("2024-01-10").cast("date"), F.col("value"), F.when(F.col("value").isNotNull(), F.lit(50.0))).alias("holds"))


@query("v37_names_by_zoom", duck("SELECT trip_id, CASE WHEN trip_id % 3 = 0 THEN true ELSE mode = 'regional' AND trip_id % 3 = 1 END AS named FROM {dv_trips}"))
def v37(spark, d):
    zoom = F.when(F.col("trip_id") % 3 == 0, 15).when(F.col("trip_id") % 3 == 1, 14).otherwise(13)
    return view(spark, d, "dv_trips").select("trip_id", ((zoom >= 15) | ((zoom >= 14) & (F.col("mode") == "regional"))).alias("named"))


@query("v33_visit_report", duck("SELECT event_type AS page, count(*) AS visits, count(DISTINCT user_id % 256) AS places FROM {events} WHERE event_type <> 'error' GROUP BY event_type"))
def v33(spark, d):
    e = table(spark, d, "events").where("event_type <> 'error'")
    ip = text.short_ip(F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".9")))
    return e.groupBy(F.col("event_type").alias("page")).agg(F.count(F.lit(1)).alias("visits"), F.countDistinct(ip).alias("places"))


@query("v20_modes_in_order", duck("SELECT line, list_filter(['subway', 'tram', 'bus', 'suburban', 'regional'], lambda m: list_contains(l, m)) AS modes FROM (SELECT line, list(DISTINCT mode) AS l FROM {dv_trips} GROUP BY line)"))
def v20(spark, d):
    l = view(spark, d, "dv_trips").groupBy("line").agg(F.collect_set("mode").alias("l"))
    return l.select("line", F.filter(F.array(*[F.lit(m) for m in text.MODES]), lambda m: F.array_contains("l", m)).alias("modes"))


@query("v15_blank_reports", duck("SELECT s.trip_id, s.pos, u.delay, u.delay IS NOT NULL AS own FROM {dv_stop_times} s LEFT JOIN {dv_updates} u ON u.trip_id = s.trip_id AND u.pos = s.pos WHERE s.trip_id IN (SELECT trip_id FROM {dv_updates})"))
def v15(spark, d):
    u = view(spark, d, "dv_updates").select("trip_id", F.col("pos").cast("int").alias("pos"), "delay")
    s = view(spark, d, "dv_stop_times").join(u.select("trip_id").distinct(), "trip_id", "left_semi")
    return s.join(u, ["trip_id", "pos"], "left").select("trip_id", "pos", "delay", F.col("delay").isNotNull().alias("own"))


@query("a17_median_by_day", duck("SELECT agency, list_sort(list(n))[len(list(n)) // 2 + 1] AS median FROM (SELECT agency, service_date, count(*) AS n FROM {dv_trips} GROUP BY ALL) GROUP BY agency"))
def a17b(spark, d):
    return view(spark, d, "dv_trips").groupBy("agency", "service_date").count().groupBy("agency").agg(ag.upper_median("count").cast("long").alias("median"))


@query("v29_reused_extent", duck("SELECT stop_id, count(*) AS calls, true AS reused FROM {dv_stop_times} JOIN {dv_stops} USING (stop_id) WHERE lat BETWEEN 49.02 AND 49.06 AND lon BETWEEN 10.9 AND 11.0 GROUP BY stop_id"))
def v29(spark, d):
    """Calls of an area, from the stored table of a wider one."""
    name, sources = "calls_of_area", [f"{d}/{t}.parquet" for t in ("lineitem", "nation")]

    def area(extent):
        s, w, n, e = extent
        return lambda: view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops"), "stop_id").where(F.col("lat").between(s, n) & F.col("lon").between(w, e))

    wide, narrow = (49.0, 10.8, 49.07, 11.1), (49.02, 10.9, 49.06, 11.0)
    derived(spark, name, sources, area(wide), extent=wide)
    held, reused = derived(spark, name, sources, area(narrow), extent=narrow)
    inside = F.col("lat").between(49.02, 49.06) & F.col("lon").between(10.9, 11.0)
    return held.where(inside).groupBy("stop_id").agg(F.count(F.lit(1)).alias("calls")).withColumn("reused", F.lit(reused))


@query("v27_bucketed_trips", duck("SELECT t.line, s.stop_id, count(*) AS calls, min(s.dep_s) AS first FROM {dv_trips} t JOIN {dv_stop_times} s ON s.trip_id = t.trip_id GROUP BY ALL"))
def v27b(spark, d):
    """The calls of lines from trips and calls that lie in buckets by trip: the join moves no row."""
    return _bucketed_calls(spark, d).groupBy("line", "stop_id").agg(F.count(F.lit(1)).alias("calls"), F.min("dep_s").alias("first"))


def _bucketed_calls(spark, d):
    sources = [f"{d}/{t}.parquet" for t in ("lineitem", "orders")]
    trips, calls = (bucketed(spark, name, sources, lambda n=name: view(spark, d, n), ["trip_id"], 16) for name in ("dv_trips", "dv_stop_times"))
    return trips.select("trip_id", "line").hint("merge").join(calls.select("trip_id", "stop_id", "dep_s"), "trip_id")
