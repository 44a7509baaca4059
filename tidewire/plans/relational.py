"""Queries over the joins, sequences, aggregates, sets and boards."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, time
from ..operators import aggregates as ag
from ..operators import frequency, graph, joins, lines, map_view, sets, topk, vehicles
from ..operators import sequences as seq
from . import frequency_sql
from .registry import query
from .transit import duck, table, view

_M = "sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(b.lat - a.lat, 2)) * 111320"
_R = "{dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id"


def _calls(spark, d):
    return view(spark, d, "dv_stop_times").join(view(spark, d, "dv_stops"), "stop_id")


def _stations(spark, d):
    return _calls(spark, d).select("trip_id", "pos", "station_id", "arr_s", "dep_s")


@query("j01_equi_join", duck("SELECT s.trip_id, s.pos, t.mode, st.name FROM {dv_stop_times} s JOIN {dv_trips} t ON t.trip_id = s.trip_id JOIN {dv_stops} st ON st.stop_id = s.stop_id"))
def j01(spark, d):
    return _calls(spark, d).join(view(spark, d, "dv_trips"), "trip_id").select("trip_id", "pos", "mode", "name")


@query("j02_intern", duck("SELECT o_orderkey, dense_rank() OVER (ORDER BY f) AS id FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_orderpriority) AS f FROM {orders})"))
def j02(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    book = o.groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("f"))
    book = book.select("o_orderpriority", F.dense_rank().over(Window.orderBy("f")).alias("id"))  # a row a distinct value
    return o.join(book, "o_orderpriority").select("o_orderkey", "id")


@query("j03_ordered_ids", duck("SELECT a.doc_id, b.item_id FROM {documents} a JOIN {benchmark} b ON b.item_id = a.doc_id"))
def j03(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "benchmark"), F.col("doc_id") == F.col("item_id")).select("doc_id", "item_id")


@query("j04_semi_join_pushdown", duck(f"SELECT trip_id, pos, stop_id, arr_s, dep_s FROM {{dv_stop_times}} WHERE trip_id IN (SELECT s.trip_id FROM {_R} WHERE in_region)"))
def j04(spark, d):
    return joins.keep_groups_touching(view(spark, d, "dv_stop_times"), "trip_id", view(spark, d, "dv_stops").where("in_region"), "stop_id").select("trip_id", "pos", "stop_id", "arr_s", "dep_s")


@query("j05_semi_chain", duck("SELECT l_orderkey, l_partkey FROM {lineitem} WHERE l_orderkey IN (SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_mktsegment = 'BUILDING'))"))
def j05(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    return joins.semi_chain(li, (o, "o_orderkey"), (c, "c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), "l_partkey")


@query("j06_parent_closure", duck("""
WITH RECURSIVE up AS (SELECT c_custkey AS id FROM {customer} WHERE c_custkey % 97 = 0 UNION SELECT CAST(floor(id / 2) AS BIGINT) FROM up WHERE id > 1)
SELECT id FROM up"""))
def j06(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"))
    return joins.parent_closure(rows, "id", "parent", rows.where("id % 97 = 0"))


@query("j07_left_default", duck("SELECT o_orderkey, coalesce(n_name, '') AS name FROM {orders} LEFT JOIN (SELECT * FROM {nation} WHERE n_nationkey < 10) ON n_nationkey = o_custkey % 25"))
def j07(spark, d):
    n = table(spark, d, "nation").where("n_nationkey < 10").select("n_nationkey", "n_name")
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("n_nationkey"))
    return o.join(n, "n_nationkey", "left").select("o_orderkey", F.coalesce("n_name", F.lit("")).alias("name"))


_SPANS = "SELECT trip_id, min(dep_s) AS start_s, max(arr_s) AS end_s FROM {dv_stop_times} GROUP BY trip_id"


def _spans(spark, d):
    return view(spark, d, "dv_stop_times").groupBy("trip_id").agg(F.min("dep_s").alias("start_s"), F.max("arr_s").alias("end_s"))


@query("j08_interval_stabbing", duck(f"SELECT trip_id, moment FROM ({_SPANS}) JOIN (SELECT n_nationkey * 3600 AS moment FROM {{nation}}) ON moment BETWEEN start_s - 30 AND end_s + 15"))
def j08(spark, d):
    at = table(spark, d, "nation").select((F.col("n_nationkey") * 3600).alias("moment"))
    return joins.stab(_spans(spark, d), "start_s", "end_s", at, "moment", 30, 15).select("trip_id", "moment")


@query("j09_as_of_position", duck("""
SELECT t.trip_id, t.now, p.stop_id, p.pos FROM (SELECT trip_id, min(dep_s) + 1200 AS now FROM {dv_stop_times} GROUP BY trip_id) t
LEFT JOIN LATERAL (SELECT stop_id, pos FROM {dv_stop_times} s WHERE s.trip_id = t.trip_id AND s.dep_s <= t.now ORDER BY pos DESC LIMIT 1) p ON true"""))
def j09(spark, d):
    s = view(spark, d, "dv_stop_times")
    # times do not run backwards within a derived trip, so the last departure by time is the last by position; equal times go by position
    now = s.groupBy("trip_id").agg((F.min("dep_s") + 1200).alias("now"))
    last = s.groupBy("trip_id", "dep_s").agg(F.max_by("stop_id", "pos").alias("stop_id"), F.max("pos").alias("pos"))
    return joins.as_of(now, last, ["trip_id"], "now", "dep_s", ["stop_id", "pos"])


@query("j10_leaving_range_join", duck("""
SELECT s.trip_id, s.pos, st.station_id, s.dep_s FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id
WHERE s.dep_s BETWEEN 36000 - 10800 AND 36000 + 7200 AND s.dep_s >= 36000 - 30"""))
def j10(spark, d):
    return _stations(spark, d).where(F.col("dep_s").between(36_000 - 10_800, 36_000 + 7_200) & (F.col("dep_s") >= 36_000 - 30)).select("trip_id", "pos", "station_id", "dep_s")


@query("j11_reject_mismatched_updates", duck("""
WITH u AS (SELECT trip_id, CAST(pos AS INT) AS pos, CAST(event_id % 25 AS INT) AS stop_id, delay FROM {dv_updates}),
w AS (SELECT u.trip_id FROM u JOIN {dv_stop_times} s ON s.trip_id = u.trip_id AND s.pos = u.pos WHERE s.stop_id <> u.stop_id)
SELECT trip_id, pos, delay FROM u WHERE trip_id NOT IN (SELECT trip_id FROM w)"""))
def j11(spark, d):
    u = view(spark, d, "dv_updates").select("trip_id", F.col("pos").cast("int").alias("pos"), (F.col("event_id") % 25).cast("int").alias("stop_id"), "delay")
    return joins.reject_mismatched(u, view(spark, d, "dv_stop_times"), "trip_id", ["pos"], "stop_id").select("trip_id", "pos", "delay")


@query("j12_sequence_merge_join", duck("SELECT s.trip_id, s.pos, u.delay FROM {dv_stop_times} s LEFT JOIN {dv_updates} u ON u.trip_id = s.trip_id AND u.pos = s.pos"))
def j12(spark, d):
    u = view(spark, d, "dv_updates").select("trip_id", F.col("pos").cast("int").alias("pos"), "delay")
    return view(spark, d, "dv_stop_times").join(u, ["trip_id", "pos"], "left").select("trip_id", "pos", "delay")



@query("j13_shared_ways", duck(f"""
SELECT DISTINCT mode, from_id, to_id, from_dep, to_arr, trips FROM (
  SELECT mode, from_id, to_id, from_dep, to_arr, list_sort(list(DISTINCT h.trip_id)) AS trips
  FROM {{dv_hops}} h JOIN {{dv_trips}} t ON t.trip_id = h.trip_id GROUP BY mode, from_id, to_id, from_dep, to_arr, CAST(year(service_date) AS INT)) WHERE len(trips) > 1"""))
def j13(spark, d):
    t = view(spark, d, "dv_trips")
    return joins.shared_ways(view(spark, d, "dv_hops"), t, t.select("trip_id", F.year("service_date").alias("service_date")))


@query("j14_nearest_same_name", duck(f"""
SELECT a.stop_id AS k, arg_min(b.stop_id, round({_M}, 3) * 1e6 + b.stop_id) AS near FROM {{dv_stops}} a JOIN {{dv_stops}} b ON a.stop_id <> b.stop_id AND a.in_region = b.in_region AND {_M} <= 6000 GROUP BY a.stop_id"""))
def j14(spark, d):
    s = view(spark, d, "dv_stops")
    left = s.select(F.col("stop_id").alias("k"), F.col("lat").alias("y"), F.col("lon").alias("x"), "in_region")
    right = s.select(F.col("stop_id").alias("near"), "lat", "lon", "in_region")
    pairs = joins.within(left, right, 6_000, ("y", "x"), ("lat", "lon"), ["in_region"]).where("k <> near")
    return joins.nearest(pairs, "k", "near").select("k", "near")


@query("j15_nearest_homonym", duck("SELECT n_name AS name, arg_min(station_id, abs(lat - 49.03) + abs(lon - 10.95) * 1e0) AS station_id FROM (SELECT substr(name, 1, 1) AS n_name, station_id, lat, lon FROM {dv_stops} WHERE stop_id = station_id) GROUP BY n_name"))
def j15(spark, d):
    s = view(spark, d, "dv_stops").where("stop_id = station_id").withColumn("name", F.substring("name", 1, 1))
    return s.groupBy("name").agg(F.min_by("station_id", F.abs(F.col("lat") - 49.03) + F.abs(F.col("lon") - 10.95)).alias("station_id"))


@query("j16_grid_join", duck(f"SELECT a.stop_id AS one, b.stop_id AS two, round({_M}, 3) AS metres FROM {{dv_stops}} a JOIN {{dv_stops}} b ON {_M} <= 3000"))
def j16(spark, d):
    s = view(spark, d, "dv_stops")
    a, b = s.select(F.col("stop_id").alias("one"), F.col("lat").alias("y"), F.col("lon").alias("x")), s.select(F.col("stop_id").alias("two"), "lat", "lon")
    return joins.within(a, b, 3_000, ("y", "x"), ("lat", "lon")).select("one", "two", F.round("metres", 3).alias("metres"))


def _areas(spark):
    """Two areas, one within the other, as unordered border edges."""
    rings = {1: [(48.99, 10.89), (49.07, 10.89), (49.07, 11.0), (48.99, 11.0)], 2: [(49.01, 10.92), (49.05, 10.92), (49.05, 10.97), (49.01, 10.97)]}
    rows = [(k, *r[i], *r[(i + 1) % len(r)]) for k, r in rings.items() for i in range(len(r))]
    return spark.createDataFrame(rows, "area int, lat1 double, lon1 double, lat2 double, lon2 double")


@query("j17_point_in_polygon", duck("""
SELECT stop_id, 1 AS area FROM {dv_stops} WHERE lat BETWEEN 48.99 AND 49.07 AND lon BETWEEN 10.89 AND 11.0
UNION ALL SELECT stop_id, 2 FROM {dv_stops} WHERE lat BETWEEN 49.01 AND 49.05 AND lon BETWEEN 10.92 AND 10.97"""))
def j17(spark, d):
    return joins.point_in_polygon(view(spark, d, "dv_stops"), ("lat", "lon"), "stop_id", _areas(spark), "area")


def boxes(stops, area, margin):
    """(area, lat1, lon1, lat2, lon2): the border of the box around each area's stops, edge by edge."""
    b = stops.groupBy(F.col(area).alias("area")).agg(*[f(c).alias(n) for f, c, n in ((F.min, "lat", "s"), (F.min, "lon", "w"), (F.max, "lat", "n"), (F.max, "lon", "e"))])
    s, w, n, e = F.col("s") - margin, F.col("w") - margin, F.col("n") + margin, F.col("e") + margin
    ring = [(s, w), (n, w), (n, e), (s, e)]
    edges = F.array(*[F.struct(p[0].alias("lat1"), p[1].alias("lon1"), q[0].alias("lat2"), q[1].alias("lon2")) for p, q in zip(ring, ring[1:] + ring[:1], strict=True)])
    return b.select("area", F.explode(edges).alias("x")).select("area", "x.*")


@query("j18_area_in_area", duck("""
WITH i AS (SELECT station_id AS inner_area, (min(lat) + max(lat)) / 2 AS lat, (min(lon) + max(lon)) / 2 AS lon FROM {dv_stops} GROUP BY station_id),
o AS (SELECT town_id AS area, min(lat) - 0.0033 AS s, min(lon) - 0.0033 AS w, max(lat) + 0.0033 AS n, max(lon) + 0.0033 AS e FROM {dv_stops} GROUP BY town_id)
SELECT inner_area, area FROM i JOIN o ON i.lat BETWEEN s AND n AND i.lon BETWEEN w AND e"""))
def j18(spark, d):
    """The boxes of stations by the boxes of towns that hold their middles."""
    s = view(spark, d, "dv_stops")
    middle = boxes(s, "station_id", 0.001).groupBy(F.col("area").alias("inner_area")).agg(*[((F.min(c) + F.max(c)) / 2).alias(n) for c, n in (("lat1", "lat"), ("lon1", "lon"))])
    return joins.point_in_polygon(middle, ("lat", "lon"), "inner_area", boxes(s, "town_id", 0.0033), "area")


@query("j20_hop_lookup", duck("""
WITH k AS (SELECT from_id, to_id, min(to_arr - from_dep) AS seconds FROM {dv_hops} WHERE from_id % 2 = 0 GROUP BY ALL)
SELECT h.trip_id, h.pos, k.seconds, k.seconds IS NULL AS straight FROM {dv_hops} h LEFT JOIN k ON k.from_id = h.from_id AND k.to_id = h.to_id"""))
def j20(spark, d):
    h = view(spark, d, "dv_hops")
    k = h.where("from_id % 2 = 0").groupBy("from_id", "to_id").agg(F.min(F.col("to_arr") - F.col("from_dep")).alias("seconds"))
    return h.join(k, ["from_id", "to_id"], "left").select("trip_id", "pos", "seconds", F.col("seconds").isNull().alias("straight"))


@query("j21_greedy_match", duck("""
WITH RECURSIVE p AS (
  SELECT a.town_id, CAST(a.stop_id AS BIGINT) AS l, CAST(b.stop_id AS BIGINT) AS r, sqrt(pow((b.lon - a.lon) * cos(radians(a.lat)), 2) + pow(b.lat - a.lat, 2)) AS d
  FROM {dv_stops} a JOIN {dv_stops} b ON a.town_id = b.town_id WHERE a.stop_id % 2 = 0 AND b.stop_id % 2 = 1
), m AS (
  SELECT town_id, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs FROM (SELECT DISTINCT town_id FROM p)
  UNION ALL
  SELECT town_id, list_append(ls, n.l), list_append(rs, n.r) FROM (
    SELECT m.town_id, m.ls, m.rs, (SELECT arg_min({'l': l, 'r': r}, round(d, 9) * 1e6 + l + r / 100e0) FROM p WHERE p.town_id = m.town_id AND NOT list_contains(m.ls, l) AND NOT list_contains(m.rs, r)) AS n FROM m) x
  WHERE n IS NOT NULL
)
SELECT town_id, unnest(ls) AS left_id, unnest(rs) AS right_id FROM (SELECT town_id, arg_max(ls, len(ls)) AS ls, arg_max(rs, len(rs)) AS rs FROM m GROUP BY town_id)"""))
def j21(spark, d):
    s = view(spark, d, "dv_stops")
    old = s.where("stop_id % 2 = 0").select("town_id", F.col("stop_id").cast("long").alias("left_id"), "lat", "lon")
    new = s.where("stop_id % 2 = 1").select("town_id", F.col("stop_id").cast("long").alias("right_id"), "lat", "lon")
    return joins.greedy_match(old, new, "town_id")


@query("j22_resolve_with_fallbacks", duck("""
SELECT o_orderkey, coalesce(a.n_nationkey, b.n_nationkey, -1) AS found FROM {orders}
LEFT JOIN (SELECT * FROM {nation} WHERE n_nationkey % 2 = 0) a ON a.n_nationkey = o_custkey % 25 LEFT JOIN (SELECT * FROM {nation} WHERE n_nationkey % 3 = 0) b ON b.n_nationkey = o_orderkey % 25"""))
def j22(spark, d):
    n = table(spark, d, "nation")
    a = n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("a"))
    b = n.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("b"))
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("x"), (F.col("o_orderkey") % 25).alias("y"))
    return o.join(a, o.x == a.a, "left").join(b, o.y == b.b, "left").select("o_orderkey", F.coalesce("a", "b", F.lit(-1)).alias("found"))


@query("j23_resolve_unique", duck("""
SELECT k.trip_id FROM (SELECT trip_id, count(*) OVER (PARTITION BY line, mode, agency, service_date) AS n FROM {dv_trips}) k WHERE n = 1"""))
def j23(spark, d):
    w = Window.partitionBy("line", "mode", "agency", "service_date")
    return view(spark, d, "dv_trips").withColumn("n", F.count(F.lit(1)).over(w)).where("n = 1").select("trip_id")


@query("j24_anti_join", duck("SELECT DISTINCT from_id, to_id FROM {dv_hops} h WHERE NOT EXISTS (SELECT 1 FROM {dv_hops} k WHERE k.trip_id % 3 = 0 AND k.from_id = h.from_id AND k.to_id = h.to_id)"))
def j24(spark, d):
    h = view(spark, d, "dv_hops")
    return h.select("from_id", "to_id").distinct().join(h.where("trip_id % 3 = 0").select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")


@query("j25_favourite_resolve", duck(f"""
SELECT b.stop_id AS fav, arg_min(a.stop_id, round({_M}, 3) * 1e6 + a.stop_id) AS stop_id FROM {{dv_stops}} a JOIN (SELECT stop_id, name, lat + 0.004 AS lat, lon FROM {{dv_stops}} WHERE stop_id % 3 = 0) b ON a.name = b.name AND {_M} <= 1000 GROUP BY b.stop_id"""))
def j25(spark, d):
    s = view(spark, d, "dv_stops")
    fav = s.where("stop_id % 3 = 0").select(F.col("stop_id").alias("fav"), "name", (F.col("lat") + 0.004).alias("y"), F.col("lon").alias("x"))
    return joins.nearest(joins.within(fav, s.select("stop_id", "name", "lat", "lon"), 1_000, ("y", "x"), ("lat", "lon"), ["name"]), "fav", "stop_id").select("fav", "stop_id")


# ---- sequences

_CARRY = """
WITH g AS (SELECT *, CASE WHEN abs(delay) <= 21600 THEN delay END AS p, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM {dv_updates})
SELECT event_id, CASE WHEN event_type <> 'error' THEN last_value(CASE WHEN event_type <> 'error' THEN p END IGNORE NULLS) OVER (PARTITION BY trip_id, grp ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS dep_delay,
 CASE WHEN event_type <> 'error' THEN coalesce(last_value(CASE WHEN event_type <> 'error' THEN p END IGNORE NULLS) OVER (PARTITION BY trip_id, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p) END AS arr_delay FROM g"""


@query("w01_carry_forward", duck(_CARRY))
def w01(spark, d):
    u = view(spark, d, "dv_updates")
    p = F.when(F.abs("delay") <= 21_600, F.col("delay"))
    return seq.carry_forward(u, ["trip_id"], "pos", F.lit(None).cast("int"), p, F.col("event_type") == "error").select("event_id", "dep_delay", "arr_delay")


@query("w02_monotone_clamp", duck("""
WITH x AS (SELECT trip_id, pos, arr_s - (trip_id % 7) * 300 * (pos % 2) AS a, dep_s AS b FROM {dv_stop_times})
SELECT trip_id, pos, CASE WHEN m0 IS NULL THEN a ELSE greatest(a, m0) END AS arr_s, m AS dep_s FROM (SELECT *, max(greatest(a, b)) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS m,
 max(greatest(a, b)) OVER (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m0 FROM x)"""))
def w02(spark, d):
    x = view(spark, d, "dv_stop_times").select("trip_id", "pos", (F.col("arr_s") - (F.col("trip_id") % 7) * 300 * (F.col("pos") % 2)).cast("int").alias("arr_s"), "dep_s")
    return seq.clamp(x, ["trip_id"], "pos", "arr_s", "dep_s")


@query("w03_fill_times", duck("""
WITH x AS (SELECT trip_id, pos, CASE WHEN k THEN NULL ELSE arr_s END AS a, CASE WHEN k THEN NULL WHEN pos % 2 = 0 THEN NULL ELSE dep_s END AS b
  FROM (SELECT *, (trip_id + pos) % 3 = 0 AND trip_id % 2 = 0 AS k FROM {dv_stop_times})),
y AS (SELECT trip_id, pos, coalesce(a, b) AS a, coalesce(b, a) AS b FROM x),
z AS (SELECT *, last_value(b IGNORE NULLS) OVER p AS pd, last_value(CASE WHEN a IS NOT NULL THEN pos END IGNORE NULLS) OVER p AS pn,
  first_value(a IGNORE NULLS) OVER n AS na, first_value(CASE WHEN a IS NOT NULL THEN pos END IGNORE NULLS) OVER n AS nn FROM y
  WINDOW p AS (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY trip_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
v AS (SELECT *, bool_and(pd IS NOT NULL AND na IS NOT NULL) OVER (PARTITION BY trip_id) AS ok, CAST(floor(pd + (na - pd) / CAST(nullif(nn - pn, 0) AS DOUBLE) * (pos - pn) + 0.5e0) AS INT) AS f FROM z)
SELECT trip_id, pos, coalesce(a, f) AS arr_s, coalesce(b, f) AS dep_s FROM v WHERE ok"""))
def w03(spark, d):
    k = ((F.col("trip_id") + F.col("pos")) % 3 == 0) & (F.col("trip_id") % 2 == 0)
    x = view(spark, d, "dv_stop_times").select("trip_id", "pos", F.when(~k, F.col("arr_s")).alias("arr_s"), F.when(~k & (F.col("pos") % 2 != 0), F.col("dep_s")).alias("dep_s"))
    return seq.fill_times(x, ["trip_id"], "pos", "arr_s", "dep_s")


@query("w04_relative_times", duck("SELECT trip_id, pos, arr_s - first_value(dep_s) OVER (PARTITION BY trip_id ORDER BY pos) AS arr FROM {dv_stop_times}"))
def w04(spark, d):
    return vehicles.relative_times(view(spark, d, "dv_stop_times")).select("trip_id", "pos", "arr")


_STN = "SELECT s.trip_id, s.pos, st.station_id, s.dep_s, s.arr_s FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id"
_DEDUP = f"SELECT trip_id, pos, station_id FROM (SELECT *, lag(station_id) OVER (PARTITION BY trip_id ORDER BY pos) AS p FROM ({_STN})) WHERE p IS NULL OR p <> station_id"


@query("w05_dedupe_platforms", duck(_DEDUP))
def w05(spark, d):
    return seq.drop_repeats(_stations(spark, d), ["trip_id"], "pos", "station_id").select("trip_id", "pos", "station_id")


@query("w06_next_other_station", duck(f"""
WITH s AS ({_STN}) SELECT a.trip_id, a.pos, (SELECT arg_min(b.station_id, b.pos) FROM s b WHERE b.trip_id = a.trip_id AND b.pos > a.pos AND b.station_id <> a.station_id) AS following FROM s a"""))
def w06(spark, d):
    return seq.next_other(_stations(spark, d), ["trip_id"], "pos", "station_id").select("trip_id", "pos", "following")


@query("w07_hops", duck("SELECT DISTINCT mode, from_id, to_id FROM {dv_hops} h JOIN {dv_trips} t ON t.trip_id = h.trip_id"))
def w07(spark, d):
    h = vehicles.hops(view(spark, d, "dv_stop_times"))
    return h.join(view(spark, d, "dv_trips"), "trip_id").select("mode", "from_id", "to_id").distinct()


@query("w08_delta_coding", duck("SELECT event_id, CAST(floor(value * 100) AS BIGINT) - coalesce(lag(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta, CAST(floor(value * 100) AS BIGINT) AS value FROM {events}"))
def w08(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.floor(F.col("value") * 100).alias("v"))
    coded = seq.delta(e, ["user_id"], "event_id", "v").drop("v")
    return seq.undelta(coded, ["user_id"], "event_id", "delta").select("event_id", "delta", "value")


@query("w09_cyclic_day_span", duck(f"""
WITH t AS (SELECT DISTINCT station_id, dep_s % 86400 AS t FROM ({_STN})),
g AS (SELECT *, lag(t) OVER (PARTITION BY station_id ORDER BY t) AS p FROM t),
m AS (SELECT station_id, min(t) AS lo, max(t) AS hi, max(t - p) AS gap FROM g GROUP BY station_id),
b AS (SELECT g.station_id, min(g.t) AS f FROM g JOIN m ON m.station_id = g.station_id WHERE g.t - g.p = m.gap GROUP BY g.station_id),
r AS (SELECT m.station_id, CASE WHEN gap > lo + 86400 - hi THEN f ELSE lo END AS first, CASE WHEN gap > lo + 86400 - hi THEN f - gap ELSE hi END AS last FROM m LEFT JOIN b ON b.station_id = m.station_id)
SELECT station_id, first, CASE WHEN last < first THEN last + 86400 ELSE last END AS last FROM r"""))
def w09(spark, d):
    t = _stations(spark, d)
    return seq.span_of_day(t, ["station_id"], "dep_s")


@query("w10_in_day_shift", duck("SELECT trip_id, pos, CASE WHEN dep_s < 14400 THEN dep_s + 86400 ELSE dep_s END AS dep_s FROM {dv_stop_times}"))
def w10(spark, d):
    return view(spark, d, "dv_stop_times").select("trip_id", "pos", seq.in_day(F.col("dep_s"), F.lit(14_400)).alias("dep_s"))


_DEPARTURES = f"SELECT station_id, 0 AS day, CAST(floor(dep_s / 60.0e0) AS BIGINT) AS m FROM ({_STN})"


@query("w11_hourly_frequency", duck(frequency_sql.hourly(_DEPARTURES, ["station_id"])))
def w11(spark, d):
    return frequency.hourly(_stations(spark, d).withColumns({"minute": F.floor(F.col("dep_s") / 60), "day": F.lit(0)}), ["station_id"], "day", "minute")


_TIMED = f"SELECT s.station_id, line, service_date AS day, CAST(floor(dep_s / 60.0e0) AS BIGINT) AS m FROM ({_STN}) s JOIN {{dv_trips}} USING (trip_id)"


@query("w13_one_word", duck(frequency_sql.hourly(f"SELECT line, station_id, 0 AS day, m FROM ({_TIMED}) WHERE m >= 1000", ["station_id", "line"], ["station_id"])))
def w13(spark, d):
    """The evening hours of a station's lines, read together."""
    t = _stations(spark, d).join(view(spark, d, "dv_trips"), "trip_id").withColumns({"minute": F.floor(F.col("dep_s") / 60), "day": F.lit(0)}).where("minute >= 1000")
    by = ["station_id", "line"]
    return frequency.one_word(frequency.runs(frequency.hours(t, by, "day", "minute"), by), ["station_id"], by)


@query("w12_run_merge", duck("""
WITH h AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h, count(*) AS n FROM {events} GROUP BY ALL),
g AS (SELECT *, h - row_number() OVER (PARTITION BY user_id, n ORDER BY h) AS g FROM h)
SELECT user_id, n, min(h) AS start, max(h) AS stop FROM g GROUP BY user_id, n, g"""))
def w12(spark, d):
    h = table(spark, d, "events").select("user_id", F.floor(F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts")) / 3600).alias("h"))
    h = h.groupBy("user_id", "h").agg(F.count(F.lit(1)).alias("c"))
    return seq.islands(h, ["user_id", "c"], "h").select("user_id", F.col("c").alias("n"), "start", "stop")


@query("w14_longest_stretch", duck("""
WITH d AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS h FROM {events}),
g AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS g FROM d), r AS (SELECT user_id, min(h) AS start, count(*) AS n FROM g GROUP BY user_id, g)
SELECT user_id, max(n) AS n, arg_max(start, n * 1000000 - start) AS start FROM r GROUP BY user_id"""))
def w14(spark, d):
    day = table(spark, d, "events").select("user_id", F.floor(F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts")) / 86400).alias("h"))
    r = seq.islands(day, ["user_id"], "h")
    return r.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("start", F.struct("n", -F.col("start"))).alias("start"))


@query("w15_top_k_per_group", duck("SELECT o_custkey, o_orderkey FROM {orders} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3"))
def w15(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return topk.first_rows(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@query("w16_trip_order", duck(f"SELECT trip_id, row_number() OVER (PARTITION BY service_date ORDER BY start_s, trip_id) AS by_start, row_number() OVER (PARTITION BY service_date ORDER BY end_s, trip_id) AS by_end FROM ({_SPANS}) JOIN {{dv_trips}} USING (trip_id)"))
def w16(spark, d):
    day = Window.partitionBy("service_date")
    j = _spans(spark, d).join(view(spark, d, "dv_trips"), "trip_id")
    return j.select("trip_id", F.row_number().over(day.orderBy("start_s", "trip_id")).alias("by_start"), F.row_number().over(day.orderBy("end_s", "trip_id")).alias("by_end"))


@query("w17_position_on_track", duck("""
WITH k AS (SELECT s.trip_id, s.pos, s.dep_s AS t, st.lat, st.lon FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id),
n AS (SELECT *, lead(t) OVER w AS u, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY trip_id ORDER BY t, pos)),
h AS (SELECT *, CASE WHEN 30000 < t OR u IS NULL OR u = t THEN 0e0 ELSE (30000 - t) / CAST(u - t AS DOUBLE) END AS f FROM n WHERE (t <= 30000 AND (30000 < u OR u IS NULL)) OR (n = 1 AND 30000 < t))
SELECT trip_id, round(lat + CASE WHEN f = 0 THEN 0 ELSE (lat2 - lat) * f END, 9) AS lat, round(lon + CASE WHEN f = 0 THEN 0 ELSE (lon2 - lon) * f END, 9) AS lon FROM h"""))
def w17(spark, d):
    k = _calls(spark, d).select("trip_id", F.col("dep_s").alias("t"), "pos", "lat", "lon")
    k = k.withColumn("t", F.col("t") * 1.0)
    p = seq.position_at(k, ["trip_id"], "t", F.lit(30_000.0), ["lat", "lon"], "pos")
    return p.select("trip_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("w18_first_of_later_day", duck("SELECT user_id, min(event_id) AS first FROM {events} WHERE CAST(ts AS DATE) > DATE '2024-01-10' GROUP BY user_id"))
def w18(spark, d):
    later = F.when(F.col("ts").cast("date") > F.lit("2024-01-10").cast("date"), F.col("event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min(later).alias("first")).where("first IS NOT NULL")


@query("w19_day_ranges", duck("""
WITH d AS (SELECT DISTINCT agency, CAST(date_diff('day', DATE '1970-01-01', service_date) AS BIGINT) AS n FROM {dv_trips} WHERE isodow(service_date) <= 5),
g AS (SELECT agency, n, n - row_number() OVER (PARTITION BY agency ORDER BY n) AS g FROM d)
SELECT agency, min(n) AS start, max(n) AS stop, count(*) AS n FROM g GROUP BY agency, g"""))
def w19(spark, d):
    t = view(spark, d, "dv_trips").where(F.weekday("service_date") < 5).select("agency", F.unix_date("service_date").cast("long").alias("k"))
    return seq.islands(t, ["agency"], "k")


@query("w20_served_range", duck("SELECT trip_id, min(pos) AS first, max(pos) AS last FROM {dv_stop_times} WHERE stop_id % 4 <> 0 GROUP BY trip_id"))
def w20(spark, d):
    return seq.served_range(view(spark, d, "dv_stop_times"), ["trip_id"], "pos", F.col("stop_id") % 4 == 0)


@query("a02_dictionary_encode", duck("""
WITH l AS (SELECT l_orderkey AS k, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS s FROM {lineitem} GROUP BY l_orderkey)
SELECT k, min(k) OVER (PARTITION BY s) AS id FROM l"""))
def a02(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity").alias("o"), "l_returnflag")
    return seq.dictionary_encode(li, "k", "o", ["l_returnflag"])[1]


# ---- aggregates

@query("a01_calls_per_stop", duck("SELECT stop_id, count(*) AS calls FROM {dv_stop_times} GROUP BY stop_id"))
def a01(spark, d):
    book, members = seq.dictionary_encode(view(spark, d, "dv_stop_times"), "trip_id", "pos", ["stop_id"])
    return ag.calls_per_stop(members, book)


@query("a03_min_max_per_pattern", duck("""
WITH p AS (SELECT trip_id, list(stop_id ORDER BY pos) AS s, min(dep_s) AS a, max(arr_s) AS b FROM {dv_stop_times} GROUP BY trip_id)
SELECT min(trip_id) AS id, count(*) AS trips, min(a) AS earliest, max(b) AS latest FROM p GROUP BY s"""))
def a03(spark, d):
    _, members = seq.dictionary_encode(view(spark, d, "dv_stop_times"), "trip_id", "pos", ["stop_id"])
    return members.join(_spans(spark, d), "trip_id").groupBy("id").agg(F.count(F.lit(1)).alias("trips"), F.min("start_s").alias("earliest"), F.max("end_s").alias("latest"))


@query("a04_bbox", duck("SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM {dv_stops} WHERE in_region"))
def a04(spark, d):
    return view(spark, d, "dv_stops").where("in_region").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


_BIT = "CASE mode WHEN 'tram' THEN 1 WHEN 'bus' THEN 2 ELSE 4 END"


@query("a05_mode_bits", duck(f"SELECT station_id, bit_or({_BIT}) AS modes FROM ({_STN}) JOIN {{dv_trips}} USING (trip_id) GROUP BY station_id"))
def a05(spark, d):
    return _stations(spark, d).join(view(spark, d, "dv_trips"), "trip_id").groupBy("station_id").agg(F.bit_or(F.expr(_BIT)).alias("modes"))


@query("a06_service_counts", duck(f"SELECT station_id, count(*) AS calls, count(DISTINCT trip_id) AS trips FROM ({_STN}) GROUP BY station_id"))
def a06(spark, d):
    return _stations(spark, d).groupBy("station_id").agg(F.count(F.lit(1)).alias("calls"), F.countDistinct("trip_id").alias("trips"))


@query("a07_weighted_centroid", duck("SELECT station_id, round(sum(lat * c) / sum(c), 9) AS lat, round(sum(lon * c) / sum(c), 9) AS lon FROM {dv_stops} JOIN (SELECT stop_id, count(*) AS c FROM {dv_stop_times} GROUP BY stop_id) USING (stop_id) GROUP BY station_id"))
def a07(spark, d):
    c = view(spark, d, "dv_stop_times").groupBy("stop_id").count()
    out = ag.centroid(view(spark, d, "dv_stops").join(c, "stop_id"), ["station_id"], "lat", "lon", F.col("count"))
    return out.select("station_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


_NEAR = "sqrt(pow(({1}.lon - {0}.lon) * cos(radians(({0}.lat + {1}.lat) / 2)), 2) + pow({1}.lat - {0}.lat, 2)) * 111320 <= 25"


@query("a08_places_near", duck(f"""
WITH c AS (SELECT st.station_id, t.mode, avg(st.lat + CASE WHEN t.mode = 'bus' THEN 0.0001e0 WHEN t.mode = 'tram' THEN 0.0005e0 ELSE 0 END) AS lat, avg(st.lon) AS lon, count(*) AS n
  FROM {{dv_stop_times}} s JOIN {{dv_stops}} st ON st.stop_id = s.stop_id JOIN {{dv_trips}} t ON t.trip_id = s.trip_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY n DESC, mode) AS i FROM c),
x AS (SELECT a.station_id, a.lat AS lat1, a.lon AS lon1, a.mode AS m1, b.mode AS m2, d.mode AS m3, b.lat AS lat2, b.lon AS lon2, d.lat AS lat3, d.lon AS lon3,
  {_NEAR.format('a', 'b')} AS ab, {_NEAR.format('a', 'd')} AS ad, {_NEAR.format('b', 'd')} AS bd
  FROM r a LEFT JOIN r b ON b.station_id = a.station_id AND b.i = 2 LEFT JOIN r d ON d.station_id = a.station_id AND d.i = 3 WHERE a.i = 1),
f AS (
  SELECT station_id, 0 AS place, lat1 AS lat, lon1 AS lon, list_sort(list_filter([m1, CASE WHEN ab THEN m2 END, CASE WHEN ad THEN m3 END], lambda v: v IS NOT NULL)) AS modes FROM x
  UNION ALL SELECT station_id, 1, lat2, lon2, list_sort(list_filter([m2, CASE WHEN NOT ad AND bd THEN m3 END], lambda v: v IS NOT NULL)) FROM x WHERE NOT ab
  UNION ALL SELECT station_id, CASE WHEN ab THEN 1 ELSE 2 END, lat3, lon3, [m3] FROM x WHERE NOT ad AND (ab OR NOT bd)
)
SELECT station_id, place, round(lat, 9) AS lat, round(lon, 9) AS lon, modes FROM f"""))
def a08(spark, d):
    m = _calls(spark, d).join(view(spark, d, "dv_trips").select("trip_id", "mode"), "trip_id")
    moved = F.col("lat") + F.when(F.col("mode") == "bus", 0.0001).when(F.col("mode") == "tram", 0.0005).otherwise(0.0)
    middles = ag.centroid(m.withColumn("lat", moved), ["station_id", "mode"], "lat", "lon", F.lit(1))
    return ag.merge_near(middles, "station_id").select("station_id", "place", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "modes")


@query("a09_headsign_top2", duck("SELECT line, mode, n FROM (SELECT line, mode, count(*) AS n FROM {dv_trips} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY line ORDER BY n DESC, mode) <= 2"))
def a09(spark, d):
    return ag.top_values(view(spark, d, "dv_trips"), ["line"], "mode", 2).select("line", "mode", "n")


@query("a10_line_centroid", duck("SELECT line, mode, round(avg(lat), 9) AS lat FROM (SELECT DISTINCT line, mode, stop_id, lat FROM {dv_stop_times} JOIN {dv_trips} USING (trip_id) JOIN {dv_stops} USING (stop_id)) GROUP BY ALL"))
def a10(spark, d):
    x = _calls(spark, d).join(view(spark, d, "dv_trips"), "trip_id").select("line", "mode", "stop_id", "lat").distinct()
    return x.groupBy("line", "mode").agg(F.round(F.avg("lat"), 9).alias("lat"))


_PAIRS = "SELECT c_custkey AS m, c_nationkey * 1000 + c_custkey % 997 AS s FROM {customer} UNION ALL SELECT c_custkey, c_nationkey * 1000 + c_custkey % 13 FROM {customer} WHERE c_acctbal > 5000"


@query("a11_lines_components", duck(f"""
WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT DISTINCT a.s AS x, b.s AS y FROM p a JOIN p b ON a.m = b.m),
r AS (SELECT DISTINCT s AS x, s AS y FROM p UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x, min(y) AS c FROM r GROUP BY x), k AS (SELECT m, c FROM p JOIN c ON c.x = p.s)
SELECT DISTINCT m, min(m) OVER (PARTITION BY c) AS root FROM k"""))
def a11(spark, d):
    c = table(spark, d, "customer")
    one = c.select(F.col("c_custkey").alias("m"), (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 997).alias("s"))
    two = c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("m"), (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 13).alias("s"))
    return graph.group_by_shared(one.unionByName(two), "m", "s", []).select("m", "root")


@query("a12_agreed_delay", duck("""
WITH r AS (SELECT user_id, CAST(floor(value / 20) * 60 AS BIGINT) AS delay, event_type = 'click' AS own FROM {events} WHERE event_type <> 'view'),
c AS (SELECT user_id, delay, count(*) FILTER (WHERE own) AS o, count(*) AS a FROM r GROUP BY ALL), m AS (SELECT user_id, sum(o) AS s FROM c GROUP BY user_id)
SELECT c.user_id, CASE WHEN any_value(s) > 0 THEN arg_max(delay, o * 1000000 + delay) FILTER (WHERE o > 0) ELSE arg_max(delay, a * 1000000 + delay) END AS agreed FROM c JOIN m ON m.user_id = c.user_id GROUP BY c.user_id"""))
def a12(spark, d):
    e = table(spark, d, "events").where("event_type <> 'view'")
    r = e.select("user_id", (F.floor(F.col("value") / 20) * 60).alias("delay"), (F.col("event_type") == "click").alias("own"))
    return ag.agreed(r, ["user_id"], "delay", "own")


@query("a13_counts_per_mode", duck("SELECT mode, count(*) AS n FROM {dv_trips} GROUP BY mode"))
def a13(spark, d):
    return view(spark, d, "dv_trips").groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


@query("a14_upper_median", duck(f"SELECT line, list_sort(list(end_s - start_s))[len(list(end_s)) // 2 + 1] AS median FROM ({_SPANS}) JOIN {{dv_trips}} USING (trip_id) GROUP BY line"))
def a14(spark, d):
    j = _spans(spark, d).join(view(spark, d, "dv_trips"), "trip_id")
    return j.groupBy("line").agg(ag.upper_median("end_s - start_s").cast("int").alias("median"))


@query("a15_distinct_sorted", duck("SELECT user_id, list_sort(list(DISTINCT event_type)) AS kinds FROM {events} GROUP BY user_id"))
def a15(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))


@query("a16_busiest_station", duck(f"SELECT line, arg_max(station_id, n * 1000 - station_id) AS station_id, max(n) AS n FROM (SELECT line, station_id, count(*) AS n FROM ({_STN}) JOIN {{dv_trips}} USING (trip_id) GROUP BY ALL) GROUP BY line"))
def a16(spark, d):
    return ag.busiest(_stations(spark, d).join(view(spark, d, "dv_trips"), "trip_id").select("line", "station_id", F.col("station_id").alias("o")), ["line"], "station_id", "o")


@query("a17_days_alike", duck("""
WITH l AS (SELECT agency, service_date, list_sort(list(DISTINCT line)) AS s FROM {dv_trips} GROUP BY ALL)
SELECT agency, isodow(service_date) > 5 AS weekend, s AS lines, count(*) AS days, min(service_date) AS first FROM l GROUP BY ALL"""))
def a17(spark, d):
    day = view(spark, d, "dv_trips").groupBy("agency", "service_date").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return day.groupBy("agency", (F.weekday("service_date") > 4).alias("weekend"), "lines").agg(F.count(F.lit(1)).alias("days"), F.min("service_date").alias("first"))


@query("a18_range_over_days", duck("SELECT line, min(n) AS few, max(n) AS many FROM (SELECT line, service_date, count(*) AS n FROM {dv_trips} GROUP BY ALL) GROUP BY line"))
def a18(spark, d):
    return view(spark, d, "dv_trips").groupBy("line", "service_date").count().groupBy("line").agg(F.min("count").alias("few"), F.max("count").alias("many"))


@query("a19_nearest_towns", duck(f"SELECT k, town_id, n FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM (SELECT a.stop_id AS k, b.town_id, min({_M}) AS m FROM {{dv_stops}} a JOIN {{dv_stops}} b ON a.town_id <> b.town_id GROUP BY a.stop_id, b.town_id)) QUALIFY row_number() OVER (PARTITION BY k ORDER BY m, town_id) <= 2"))
def a19(spark, d):
    s = view(spark, d, "dv_stops")
    # every town is asked for, so all stops of the few towns meet: the stops here are the 25 of the derived view
    a, b = s.alias("a"), s.alias("b")
    m = geo.metres(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    t = a.join(b, F.col("a.town_id") != F.col("b.town_id")).groupBy(F.col("a.stop_id").alias("k"), F.col("b.town_id").alias("town_id")).agg(F.min(m).alias("m"))
    w = Window.partitionBy("k")
    return t.withColumns({"n": F.count(F.lit(1)).over(w), "r": F.row_number().over(w.orderBy("m", "town_id"))}).where("r <= 2").select("k", "town_id", "n")


@query("a20_names_in_two_kinds", duck("SELECT line FROM {dv_trips} GROUP BY line HAVING count(DISTINCT mode) > 1"))
def a20(spark, d):
    return view(spark, d, "dv_trips").groupBy("line").agg(F.countDistinct("mode").alias("n")).where("n > 1").select("line")


@query("a21_town_rollup", duck("SELECT town_id, count(*) AS stops, min(lat) AS south, max(lat) AS north, arg_max(stop_id, c * 1000 - stop_id) AS biggest FROM {dv_stops} JOIN (SELECT stop_id, count(*) AS c FROM {dv_stop_times} GROUP BY stop_id) USING (stop_id) GROUP BY town_id"))
def a21(spark, d):
    c = view(spark, d, "dv_stop_times").groupBy("stop_id").agg(F.count(F.lit(1)).alias("c"))
    return view(spark, d, "dv_stops").join(c, "stop_id").groupBy("town_id").agg(
        F.count(F.lit(1)).alias("stops"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.max_by("stop_id", F.struct("c", -F.col("stop_id"))).alias("biggest"))


@query("a22_place_score", duck(f"SELECT a.stop_id AS one, sum(c * bit_count(b.stop_id)) AS score FROM {{dv_stops}} a JOIN {{dv_stops}} b ON {_M} <= 3000 JOIN (SELECT stop_id, count(*) AS c FROM {{dv_stop_times}} GROUP BY stop_id) k ON k.stop_id = b.stop_id GROUP BY a.stop_id"))
def a22(spark, d):
    s = view(spark, d, "dv_stops")
    c = view(spark, d, "dv_stop_times").groupBy("stop_id").agg(F.count(F.lit(1)).alias("c"))
    b = s.join(c, "stop_id").select(F.col("stop_id").alias("two"), "lat", "lon", "c")
    near = joins.within(s.select(F.col("stop_id").alias("one"), F.col("lat").alias("y"), F.col("lon").alias("x")), b, 3_000, ("y", "x"), ("lat", "lon"))
    return near.groupBy("one").agg(F.sum(F.col("c") * F.bit_count("two")).alias("score"))


@query("a23_lines_at_station", duck(f"SELECT station_id, line, count(*) AS n FROM ({_STN}) JOIN {{dv_trips}} USING (trip_id) GROUP BY ALL"))
def a23(spark, d):
    return _stations(spark, d).join(view(spark, d, "dv_trips"), "trip_id").groupBy("station_id", "line").agg(F.count(F.lit(1)).alias("n"))


_NEXT = f"WITH s AS ({_STN}), f AS (SELECT a.*, (SELECT arg_min(b.station_id, b.pos) FROM s b WHERE b.trip_id = a.trip_id AND b.pos > a.pos AND b.station_id <> a.station_id) AS following FROM s a)"


@query("a24_way_histogram", duck(f"{_NEXT} SELECT station_id, line, following, count(*) AS trips FROM f JOIN {{dv_trips}} USING (trip_id) WHERE following IS NOT NULL GROUP BY ALL"))
def a24(spark, d):
    f = seq.next_other(_stations(spark, d), ["trip_id"], "pos", "station_id").where("following IS NOT NULL")
    return f.join(view(spark, d, "dv_trips"), "trip_id").groupBy("station_id", "line", "following").agg(F.count(F.lit(1)).alias("trips"))


@query("a25_directions", duck(f"{_NEXT} SELECT station_id, following, count(*) AS trips, list_sort(list(DISTINCT mode)) AS modes FROM f JOIN {{dv_trips}} USING (trip_id) WHERE following IS NOT NULL GROUP BY ALL"))
def a25(spark, d):
    f = seq.next_other(_stations(spark, d), ["trip_id"], "pos", "station_id").where("following IS NOT NULL")
    return f.join(view(spark, d, "dv_trips"), "trip_id").groupBy("station_id", "following").agg(F.count(F.lit(1)).alias("trips"), F.array_sort(F.collect_set("mode")).alias("modes"))


def _runs(spark, d):
    s = seq.drop_repeats(_stations(spark, d), ["trip_id"], "pos", "station_id")
    runs = s.groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "station_id"))), lambda x: x["station_id"]).alias("stops"))
    return runs.join(view(spark, d, "dv_trips"), "trip_id")


_RUNS = f"SELECT trip_id, list(station_id ORDER BY pos) AS stops FROM ({_DEDUP}) GROUP BY trip_id"


@query("a26_line_runs", duck(f"SELECT line, stops, count(*) AS n FROM ({_RUNS}) JOIN {{dv_trips}} USING (trip_id) GROUP BY ALL"))
def a26(spark, d):
    return _runs(spark, d).groupBy("line", "stops").agg(F.count(F.lit(1)).alias("n"))


@query("a27_headline_weighted", duck(f"SELECT line, arg_max(last, w * 1000 - last) AS headline FROM (SELECT line, stops[-1] AS last, sum(len(stops)) AS w FROM ({_RUNS}) JOIN {{dv_trips}} USING (trip_id) GROUP BY ALL) GROUP BY line"))
def a27(spark, d):
    w = _runs(spark, d).groupBy("line", F.element_at("stops", -1).alias("last")).agg(F.sum(F.size("stops")).alias("w"))
    return w.groupBy("line").agg(F.max_by("last", F.struct("w", -F.col("last"))).alias("headline"))


@query("a28_start_share", duck(f"SELECT line, first, n, n >= 0.05 * sum(n) OVER (PARTITION BY line) AS often FROM (SELECT line, stops[1] AS first, count(*) AS n FROM ({_RUNS}) JOIN {{dv_trips}} USING (trip_id) GROUP BY ALL)"))
def a28(spark, d):
    n = _runs(spark, d).groupBy("line", F.element_at("stops", 1).alias("first")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("line", "first", "n", (F.col("n") >= F.sum("n").over(Window.partitionBy("line")) * 0.05).alias("often"))


@query("a29_route_report", duck("SELECT mode, count(*) AS hops, count(*) FILTER (WHERE from_id % 2 = to_id % 2) AS routed, count(*) FILTER (WHERE from_id > to_id) AS back FROM (SELECT DISTINCT mode, from_id, to_id FROM {dv_hops} JOIN {dv_trips} USING (trip_id)) GROUP BY mode"))
def a29(spark, d):
    h = view(spark, d, "dv_hops").join(view(spark, d, "dv_trips"), "trip_id").select("mode", "from_id", "to_id").distinct()
    return h.groupBy("mode").agg(F.count(F.lit(1)).alias("hops"), F.count_if(F.col("from_id") % 2 == F.col("to_id") % 2).alias("routed"), F.count_if(F.col("from_id") > F.col("to_id")).alias("back"))


@query("a30_peak_half_hour", duck("SELECT start, n FROM (SELECT unnest(range(CAST((dep_s - 1800) // 300 * 300 + 300 AS BIGINT), CAST(dep_s // 300 * 300 + 1 AS BIGINT), 300)) AS start FROM {dv_stop_times}) SELECT 1".replace("SELECT start, n FROM (", "SELECT start, count(*) AS n FROM (").replace(") SELECT 1", ") GROUP BY start ORDER BY n DESC, start LIMIT 1")))
def a30(spark, d):
    return ag.sliding_peak(view(spark, d, "dv_stop_times").where("dep_s >= 1800"), "dep_s", 1800, 300)


# ---- boards, sets

@query("o01_sort_rows", duck("SELECT trip_id, list(stop_id ORDER BY pos) AS stops FROM {dv_stop_times} GROUP BY trip_id"))
def o01(spark, d):
    return view(spark, d, "dv_stop_times").groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_id"))), lambda x: x["stop_id"]).alias("stops"))


@query("o02_byte_order", duck("SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS n FROM {part}"))
def o02(spark, d):
    return map_view.global_rank(table(spark, d, "part").select("p_partkey", "p_name"), ["p_name", "p_partkey"]).select("p_partkey", F.col("rank").alias("n"))


@query("o04_departure_board", duck(f"""
WITH s AS ({_STN}), x AS (SELECT station_id, trip_id, pos, dep_s, dep_s <= 36000 + 7200 AS w FROM s WHERE dep_s BETWEEN 36000 - 30 AND 36000 + 86400),
y AS (SELECT *, sum(CAST(w AS INT)) OVER (PARTITION BY station_id ORDER BY dep_s, trip_id, pos ROWS UNBOUNDED PRECEDING) AS rw, row_number() OVER (PARTITION BY station_id ORDER BY dep_s, trip_id, pos) AS ra, sum(CAST(w AS INT)) OVER (PARTITION BY station_id) AS n FROM x)
SELECT station_id, trip_id, pos, dep_s FROM y WHERE (least(n, 40) >= 10 AND w AND rw <= 40) OR (least(n, 40) < 10 AND ra <= 10)"""))
def o04(spark, d):
    x = _stations(spark, d).where(F.col("dep_s").between(36_000 - 30, 36_000 + 86_400)).withColumn("w", F.col("dep_s") <= 36_000 + 7_200)
    return topk.board(x, ["station_id"], ["dep_s", "trip_id", "pos"], "w").select("station_id", "trip_id", "pos", "dep_s")


@query("o06_bounded_top_k", duck("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"))
def o06(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("o08_line_sort", duck(r"SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey % 3, s_suppkey) AS n FROM {supplier}"))
def o08(spark, d):
    from ..functions.text import natural_key

    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_nationkey") % 3).alias("mode"), natural_key(F.concat(F.lit("Bus "), F.col("s_suppkey").cast("string"))).alias("name"))
    return map_view.global_rank(s, ["mode", "name"]).select("s_suppkey", F.col("rank").alias("n"))


@query("o09_merged_board", duck(f"""
WITH b AS (SELECT station_id, trip_id, dep_s FROM ({_STN}) WHERE dep_s BETWEEN 36000 AND 40000), e AS (SELECT station_id, max(dep_s) AS e, count(*) AS n FROM b GROUP BY station_id)
SELECT station_id, trip_id, dep_s FROM b WHERE dep_s <= coalesce((SELECT min(e) FROM e WHERE n >= 10), dep_s)"""))
def o09(spark, d):
    b = _stations(spark, d).where("dep_s BETWEEN 36000 AND 40000").select("station_id", "trip_id", "dep_s")
    return topk.merged_board(b, "station_id", "dep_s", 10, ["station_id", "trip_id"])


@query("o10_picks_apart", duck(f"""
WITH RECURSIVE c AS (SELECT st.stop_id, st.lat, st.lon, count(*) AS c FROM {{dv_stop_times}} s JOIN {{dv_stops}} st ON st.stop_id = s.stop_id GROUP BY ALL),
far AS (SELECT a.stop_id AS i, b.stop_id AS j FROM c a JOIN c b ON {_M} < 4000),
p AS (
  SELECT 0 AS n, CAST([] AS INT[]) AS ids
  UNION ALL
  SELECT n + 1, list_append(ids, best) FROM (
    SELECT n, ids, (SELECT arg_max(stop_id, c * 1000 - stop_id) FROM c WHERE NOT EXISTS (SELECT 1 FROM far WHERE far.i = c.stop_id AND list_contains(p.ids, far.j))) AS best FROM p WHERE n < 5) x WHERE best IS NOT NULL
)
SELECT ids[n] AS stop_id, CAST(n - 1 AS INT) AS place FROM p WHERE n > 0"""))
def o10(spark, d):
    c = view(spark, d, "dv_stop_times").groupBy("stop_id").agg(F.count(F.lit(1)).alias("c"))
    return topk.picks(view(spark, d, "dv_stops").join(c, "stop_id"), "stop_id", "c", "lat", "lon", 4_000).select("stop_id", "place")


@query("o11_held_departures", duck("""
WITH a AS (SELECT stop_id, trip_id, pos, dep_s FROM {dv_stop_times} WHERE dep_s BETWEEN 36000 AND 39600), r AS (SELECT stop_id, trip_id, pos, dep_s FROM {dv_stop_times} WHERE dep_s BETWEEN 38000 AND 43200)
SELECT stop_id, trip_id, pos, dep_s, held FROM (SELECT *, false AS held FROM a UNION ALL SELECT *, true FROM r WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.trip_id = r.trip_id AND a.pos = r.pos)) WHERE dep_s >= 37000 - 30
QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY dep_s, trip_id, pos) <= 50"""))
def o11(spark, d):
    s = view(spark, d, "dv_stop_times").select("stop_id", "trip_id", "pos", "dep_s")
    return sets.held_board(s.where("dep_s BETWEEN 36000 AND 39600"), s.where("dep_s BETWEEN 38000 AND 43200"), ["stop_id"], ["trip_id", "pos"], "dep_s", 37_000, 50)


@query("o13_along_places", duck("""
WITH x AS (SELECT town_id, max(lat) - min(lat) > (max(lon) - min(lon)) * cos(radians(avg(lat))) AS by_lat FROM {dv_stops} GROUP BY town_id)
SELECT stop_id, row_number() OVER (PARTITION BY s.town_id ORDER BY CASE WHEN by_lat THEN lat ELSE lon END, stop_id) AS n FROM {dv_stops} s JOIN x ON x.town_id = s.town_id"""))
def o13(spark, d):
    s = view(spark, d, "dv_stops")
    w = Window.partitionBy("town_id")
    by_lat = F.max("lat").over(w) - F.min("lat").over(w) > (F.max("lon").over(w) - F.min("lon").over(w)) * F.cos(F.radians(F.avg("lat").over(w)))
    s = s.withColumn("at", F.when(by_lat, F.col("lat")).otherwise(F.col("lon")))
    return s.select("stop_id", F.row_number().over(w.orderBy("at", "stop_id")).alias("n"))


_CAL = """
WITH cal AS (SELECT n_nationkey AS service_id, n_nationkey % 2 AS we, n_nationkey % 3 AS wd FROM {nation}),
ex AS (SELECT o_custkey % 25 AS service_id, DATE '2026-01-01' + CAST(o_orderkey % 28 AS INT) AS date, arg_max(1 + o_orderkey % 2, o_orderkey) AS kind FROM {orders} GROUP BY ALL),
base AS (SELECT service_id, DATE '2026-01-01' + CAST(r AS INT) AS date FROM cal, range(28) AS x(r) WHERE CASE WHEN isodow(DATE '2026-01-01' + CAST(r AS INT)) > 5 THEN we = 1 ELSE wd > 0 END)
SELECT service_id, date FROM base WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.service_id = base.service_id AND ex.date = base.date AND kind = 2)
UNION SELECT service_id, date FROM ex WHERE kind = 1"""


def _services(spark, d):
    n = table(spark, d, "nation")
    wd, we = (F.col("n_nationkey") % 3 > 0).cast("int"), (F.col("n_nationkey") % 2).cast("int")
    start = F.lit("2026-01-01").cast("date")
    cal = n.select(F.col("n_nationkey").cast("long").alias("service_id"), start.alias("start_date"), F.date_add(start, 27).alias("end_date"), *[(we if i > 4 else wd).alias(x) for i, x in enumerate(sets.DAYS)])
    ex = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("service_id"), F.date_add(start, (F.col("o_orderkey") % 28).cast("int")).alias("date"), (1 + F.col("o_orderkey") % 2).alias("exception_type"), F.col("o_orderkey").alias("line"))
    return sets.service_dates(cal, ex)


@query("u01_calendar_algebra", duck(_CAL))
def u01(spark, d):
    return _services(spark, d)


@query("u02_distinct_dates", duck("SELECT DISTINCT service_date FROM {dv_trips}"))
def u02(spark, d):
    return view(spark, d, "dv_trips").select("service_date").distinct().orderBy("service_date")


@query("u03_services_intersect", duck("WITH s AS (SELECT agency, list(DISTINCT service_date) AS days FROM {dv_trips} GROUP BY agency) SELECT a.agency AS one, b.agency AS two, list_has_any(a.days, b.days) AS meet FROM s a JOIN s b ON a.agency < b.agency"))
def u03(spark, d):
    s = view(spark, d, "dv_trips").groupBy("agency").agg(F.collect_set("service_date").alias("days"))  # seven agencies
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.col("a.agency") < F.col("b.agency")).select(F.col("a.agency").alias("one"), F.col("b.agency").alias("two"), sets.any_common(F.col("a.days"), F.col("b.days")).alias("meet"))


@query("u04_first_extract_wins", duck("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal ELSE -c_acctbal END AS v FROM {customer}"))
def u04(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return sets.first_wins([c.where("c_custkey % 2 = 0"), c.withColumn("v", -F.col("v"))], ["c_custkey"])


@query("u05_union_sets", duck("""
WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM {dv_hops}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS x, a AS y FROM s UNION SELECT r.x, s.b FROM r JOIN s ON s.a = r.y) SELECT x AS node, min(y) AS root FROM r GROUP BY x"""))
def u05(spark, d):
    return graph.components(view(spark, d, "dv_hops").select(F.col("from_id").alias("src"), F.col("to_id").alias("dst")))


@query("u06_days_around", duck("SELECT trip_id, service_date + CAST(r AS INT) AS service_date FROM {dv_trips}, (SELECT unnest([-1, 0, 1]) AS r)"))
def u06(spark, d):
    return sets.days_around(view(spark, d, "dv_trips").select("trip_id", "service_date"), "service_date")


@query("u07_stretches_once", duck("SELECT DISTINCT line, least(from_id, to_id) AS a, greatest(from_id, to_id) AS b FROM {dv_hops} JOIN {dv_trips} USING (trip_id)"))
def u07(spark, d):
    return view(spark, d, "dv_hops").join(view(spark, d, "dv_trips"), "trip_id").select("line", F.least("from_id", "to_id").alias("a"), F.greatest("from_id", "to_id").alias("b")).distinct()


@query("f07_runs_on_date", duck("SELECT trip_id FROM {dv_trips} WHERE service_date = (SELECT max(service_date) FROM {dv_trips})"))
def f07(spark, d):
    t = view(spark, d, "dv_trips")
    return t.join(F.broadcast(t.agg(F.max("service_date").alias("service_date"))), "service_date", "left_semi").select("trip_id")  # one row


@query("f08_mode_filter", duck("SELECT trip_id FROM {dv_trips} WHERE mode IN ('tram', 'bus')"))
def f08(spark, d):
    return view(spark, d, "dv_trips").where(F.col("mode").isin("tram", "bus")).select("trip_id")


@query("f09_picked_override", duck("SELECT trip_id FROM {dv_trips} WHERE mode = 'tram' OR line = '1-URGENT'"))
def f09(spark, d):
    return view(spark, d, "dv_trips").where((F.col("mode") == "tram") | (F.col("line") == "1-URGENT")).select("trip_id")


@query("f14_projection", duck("SELECT trip_id, line, mode FROM {dv_trips}"))
def f14(spark, d):
    return view(spark, d, "dv_trips").select("trip_id", "line", "mode")


@query("f15_region_visits", duck("SELECT s.trip_id, s.pos FROM {dv_stop_times} s JOIN {dv_stops} st ON st.stop_id = s.stop_id WHERE in_region"))
def f15(spark, d):
    return _calls(spark, d).where("in_region").select("trip_id", "pos")


@query("f16_lines_with_stops", duck("SELECT line, count(DISTINCT s.stop_id) AS stops FROM {dv_stop_times} s JOIN {dv_trips} USING (trip_id) JOIN {dv_stops} st ON st.stop_id = s.stop_id WHERE in_region GROUP BY line HAVING count(DISTINCT s.stop_id) > 0"))
def f16(spark, d):
    return _calls(spark, d).where("in_region").join(view(spark, d, "dv_trips"), "trip_id").groupBy("line").agg(F.countDistinct("stop_id").alias("stops")).where("stops > 0")


@query("s22_last_record_wins", duck("SELECT user_id, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM {events} GROUP BY user_id"))
def s22(spark, d):
    return sets.last_wins(table(spark, d, "events").select("user_id", "value", "event_id", F.col("event_id").alias("v")), ["user_id"], "v").select("user_id", "value", "event_id")


@query("v13_notes_by_severity", duck("SELECT user_id, list(event_type ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) AS notes FROM {events} WHERE event_type IN ('error', 'purchase') GROUP BY user_id"))
def v13(spark, d):
    e = table(spark, d, "events").where(F.col("event_type").isin("error", "purchase"))
    item = F.struct(F.when(F.col("event_type") == "error", 0).otherwise(1).alias("s"), "event_id", "event_type")
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["event_type"]).alias("notes"))


@query("v22_dates_in_validity", duck("WITH b AS (SELECT min(service_date) AS lo, max(service_date) AS hi FROM {dv_trips}) SELECT CAST(lo + CAST(r AS INT) AS DATE) AS date FROM b, range(28) AS x(r) WHERE lo + CAST(r AS INT) <= hi"))
def v22(spark, d):
    b = view(spark, d, "dv_trips").agg(F.min("service_date").alias("lo"), F.max("service_date").alias("hi"))
    return b.select(F.explode(F.sequence("lo", F.least(F.col("hi"), F.date_add("lo", 27)))).alias("date"))


@query("v35_held_details", duck("SELECT user_id, event_id FROM {events} WHERE epoch(ts) >= (SELECT max(epoch(ts)) FROM {events}) - 864000 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 25"))
def v35(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("top"))
    recent = e.crossJoin(F.broadcast(newest)).where(F.col("ts") >= F.col("top") - F.expr("INTERVAL '10' DAY"))  # one row
    return recent.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("n <= 25").select("user_id", "event_id")


@query("k08_sitemap_files", duck("SELECT (n - 1) // 400 AS file, count(*) AS urls, min(o_orderkey) AS first FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM {orders}) GROUP BY ALL"))
def k08(spark, d):
    o = map_view.global_rank(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey", F.col("rank").alias("n"))
    return o.groupBy(F.floor((F.col("n") - 1) / 400).alias("file")).agg(F.count(F.lit(1)).alias("urls"), F.min("o_orderkey").alias("first"))


@query("k09_etag", duck("SELECT item_id, substr(sha1(text), 1, 16) AS etag FROM {benchmark}"))
def k09(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("etag"))


@query("r02_closed_rings", duck("WITH p AS (SELECT from_id AS k FROM {dv_hops} UNION ALL SELECT to_id FROM {dv_hops}) SELECT k, count(*) AS ends FROM p GROUP BY k HAVING count(*) % 2 = 1"))
def r02(spark, d):
    h = view(spark, d, "dv_hops")
    ends = h.select(F.col("from_id").alias("k")).unionByName(h.select(F.col("to_id").alias("k")))
    return ends.groupBy("k").agg(F.count(F.lit(1)).alias("ends")).where("ends % 2 = 1")


@query("r03_json", duck("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM {events}"))
def r03(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("r05_map_access", duck("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS v FROM {orders}"))
def r05(spark, d):
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.create_map(F.lit("status"), F.col("o_orderstatus"))).otherwise(F.create_map(F.lit("other"), F.lit("x")))
    return table(spark, d, "orders").select("o_orderkey", F.try_element_at(tags, F.lit("status")).alias("v"))


LINE = ["agency", "mode", "line"]


@query("q17_merged_sequences")
def q17(spark, d):
    """The stations of every line and direction; tested on the tables against a plain version."""
    return lines.ways(_line_runs(spark, d), LINE).select(*LINE, "direction", "list")


@query("q16_line_ways")
def q16(spark, d):
    """The ways of every line, with what branches off them; tested on the tables against a plain version."""
    return lines.ways(_line_runs(spark, d), LINE)


def _line_runs(spark, d):
    stops = F.col("stops").cast("array<long>").alias("stops")
    return _runs(spark, d).where("size(stops) > 1").groupBy(*LINE, stops).agg(F.count(F.lit(1)).alias("trips"))


@query("q44_hour_lines", duck(f"SELECT station_id, CAST(dep_s // 3600 AS INT) AS hour, list(CAST(dep_s % 3600 // 60 AS INT) ORDER BY dep_s, trip_id, pos) AS minutes FROM ({_STN}) GROUP BY ALL"))
def q44(spark, d):
    item = F.struct("dep_s", "trip_id", "pos")
    s = _stations(spark, d).groupBy("station_id", F.floor(F.col("dep_s") / 3600).cast("int").alias("hour")).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return s.select("station_id", "hour", F.transform("l", lambda x: F.floor(x["dep_s"] % 3600 / 60).cast("int")).alias("minutes"))


@query("q45_status", duck("SELECT count(*) AS trips, min(service_date) AS valid_from, max(service_date) AS valid_until FROM {dv_trips}"))
def q45(spark, d):
    return view(spark, d, "dv_trips").agg(F.count(F.lit(1)).alias("trips"), F.min("service_date").alias("valid_from"), F.max("service_date").alias("valid_until"))


@query("q10_departures", duck(f"""
WITH u AS (SELECT trip_id, pos, dep_delay FROM ({_CARRY.replace('WITH g AS', 'WITH gg AS').replace('FROM g', 'FROM gg').replace('SELECT event_id, CASE', 'SELECT trip_id, pos, CASE', 1)})),
c AS (SELECT st.station_id, s.trip_id, s.pos, t.line, t.mode, s.dep_s AS planned, u.dep_delay AS delay, s.dep_s + coalesce(u.dep_delay, 0) AS expected
  FROM {{dv_stop_times}} s JOIN {{dv_stops}} st ON st.stop_id = s.stop_id JOIN {{dv_trips}} t ON t.trip_id = s.trip_id LEFT JOIN u ON u.trip_id = s.trip_id AND u.pos = s.pos
  WHERE s.pos < (SELECT max(pos) FROM {{dv_stop_times}} z WHERE z.trip_id = s.trip_id)),
x AS (SELECT *, planned <= 43200 AND expected <= 43200 AS w FROM c WHERE planned BETWEEN 36000 - 10800 AND 36000 + 86400 AND expected BETWEEN 36000 - 30 AND 36000 + 86400),
y AS (SELECT *, sum(CAST(w AS INT)) OVER (PARTITION BY station_id ORDER BY expected, trip_id, pos ROWS UNBOUNDED PRECEDING) AS rw, row_number() OVER (PARTITION BY station_id ORDER BY expected, trip_id, pos) AS ra, sum(CAST(w AS INT)) OVER (PARTITION BY station_id) AS n FROM x)
SELECT station_id, trip_id, pos, line, mode, planned, delay, expected FROM y WHERE (least(n, 40) >= 10 AND w AND rw <= 40) OR (least(n, 40) < 10 AND ra <= 10)"""))
def q10(spark, d):
    """The departure board of every station with delays: the flagship query."""
    u = view(spark, d, "dv_updates")
    plausible = F.when(F.abs("delay") <= 21_600, F.col("delay"))
    delays = seq.carry_forward(u, ["trip_id"], "pos", F.lit(None).cast("int"), plausible, F.col("event_type") == "error")
    delays = delays.select("trip_id", F.col("pos").cast("int").alias("pos"), F.col("dep_delay").alias("delay"))
    s = view(spark, d, "dv_stop_times")
    calls = s.where("pos < last_pos AND dep_s BETWEEN 25200 AND 122400").join(view(spark, d, "dv_stops").select("stop_id", "station_id"), "stop_id")
    calls = calls.join(view(spark, d, "dv_trips").select("trip_id", "line", "mode"), "trip_id").join(delays, ["trip_id", "pos"], "left")
    x = calls.select("station_id", "trip_id", "pos", "line", "mode", F.col("dep_s").alias("planned"), "delay", (F.col("dep_s") + F.coalesce("delay", F.lit(0))).alias("expected"))
    x = x.where(F.col("expected").between(36_000 - 30, 122_400)).withColumn("w", (F.col("planned") <= 43_200) & (F.col("expected") <= 43_200))
    return topk.board(x, ["station_id"], ["expected", "trip_id", "pos"], "w").drop("w")
