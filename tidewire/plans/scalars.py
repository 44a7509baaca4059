"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, hashing, realtime, text, time
from ..operators.sequences import shared_lists
from .registry import query
from .transit import duck, table, view

_LETTERS = "[^\\p{L}\\p{N}]+"


def _slug_sql(c: str) -> str:
    out = f"lower({c})"
    for a, b in text.LETTERS.items():
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace(regexp_replace(strip_accents({out}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    return f"coalesce(nullif({out}, ''), CASE WHEN {c} IS NOT NULL THEN '-' END)"


def _fold_sql(c: str) -> str:
    return f"strip_accents(replace(lower({c}), 'ß', 'ss'))"


def _words_sql(c: str) -> str:
    return f"list_filter(string_split_regex({_fold_sql(c)}, '{_LETTERS}'), lambda w: w <> '')"


@query("x01_tidy_name", duck(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(\p{L})-[ ]*(?:_|\\n)[ ]*(\p{Ll})', '\1\2', 'g'), '(\p{L})-[ ]*(?:_|\\n)[ ]*(\p{Ll})', '\1\2', 'g'), '(\p{L})-[ ]*(?:_|\\n)[ ]*(\S)', '\1-\2', 'g'), '_|\\[nt]', ' ', 'g'), '\s+', ' ', 'g')) AS tidy
FROM (SELECT doc_id, replace(substr(text, 1, 200), ' the ', '- _') AS t FROM {documents})"""))
def x01(spark, d):
    t = F.replace(F.substring("text", 1, 200), F.lit(" the "), F.lit("- _"))
    return table(spark, d, "documents").select("doc_id", text.tidy_name(t).alias("tidy"))


@query("x02_slug", duck(f"SELECT doc_id, {_slug_sql('substr(text, 1, 80)')} AS slug FROM {{documents}}"))
def x02(spark, d):
    return table(spark, d, "documents").select("doc_id", text.slug(F.substring("text", 1, 80)).alias("slug"))


@query("x03_fold", duck(f"SELECT doc_id, {_fold_sql('text')} AS folded FROM {{documents}}"))
def x03(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("x04_folded_words", duck(f"SELECT doc_id, list_distinct_count, n_words FROM (SELECT doc_id, len(w) AS n_words, len(list_distinct(w)) AS list_distinct_count FROM (SELECT doc_id, {_words_sql('text')} AS w FROM {{documents}}))"))
def x04(spark, d):
    w = text.folded_words(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("list_distinct_count"))


@query("x05_town_to_show", duck(f"""
WITH w AS (SELECT n_nationkey, n_name, r_name, {_words_sql('r_name')} AS tw, {_words_sql("n_name || ' ' || CASE WHEN n_nationkey % 3 = 0 THEN r_name ELSE '' END")} AS nw FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey)
SELECT n_nationkey, CASE WHEN list_contains(nw, coalesce(list_filter(tw, lambda x: len(x) > 3)[1], tw[1])) THEN NULL ELSE r_name END AS town FROM w"""))
def x05(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat("n_name", F.lit(" "), F.when(F.col("n_nationkey") % 3 == 0, F.col("r_name")).otherwise(F.lit("")))
    return j.select("n_nationkey", text.town_to_show(name, F.col("r_name")).alias("town"))


@query("x07_operator_name", duck("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'company ' || c_name END AS operator FROM {customer}"""))
def x07(spark, d):
    given = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ab12cD "), "c_name")).otherwise(F.concat(F.lit("company "), "c_name"))
    return table(spark, d, "customer").select("c_custkey", text.operator_name(given).alias("operator"))


@query("x08_agency_key", duck("SELECT s_suppkey, lower(trim(' ' || s_name || ' ')) AS agency FROM {supplier}"))
def x08(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.agency_key(F.concat(F.lit(" "), "s_name", F.lit(" "))).alias("agency"))


@query("x09_addresses", duck(f"""
SELECT p_partkey, 'stop/' || {_slug_sql('p_name')} || CASE WHEN p_size > 1 THEN '/' || CAST(p_size AS VARCHAR) ELSE '' END AS stop,
       'line/' || {_slug_sql('p_brand')} || '/' || CASE WHEN p_size % 2 = 0 THEN 'bus' ELSE 'other' END || '/' || {_slug_sql('p_type')} AS line FROM {{part}}"""))
def x09(spark, d):
    mode = F.when(F.col("p_size") % 2 == 0, "bus").otherwise("zeppelin")
    return table(spark, d, "part").select(
        "p_partkey", text.stop_path(text.slug(F.col("p_name")), F.col("p_size")).alias("stop"),
        text.line_path(F.col("p_brand"), mode, F.col("p_type")).alias("line"))


@query("x10_parse_address", duck("""
SELECT p_partkey, 'line' AS type, 'a' || CAST(p_partkey % 7 AS VARCHAR) AS agency, 'tram' AS mode, 'n' || CAST(p_size AS VARCHAR) AS name, CAST(p_size AS DOUBLE) + 0.5 AS lat
FROM {part} WHERE p_size <= 89"""))
def x10(spark, d):
    path = F.concat(F.lit("line/a"), (F.col("p_partkey") % 7).cast("string"), F.lit("/tram/n"), F.col("p_size").cast("string"), F.lit("@"), F.col("p_size").cast("string"), F.lit(".5,12"))
    a = table(spark, d, "part").select("p_partkey", text.parse_address(path).alias("a")).where("a IS NOT NULL")
    return a.select("p_partkey", "a.type", "a.agency", "a.mode", "a.name", "a.lat")


_MODE_SQL = r"""CASE WHEN t = 0 THEN CASE WHEN regexp_matches(n, '^U\s?\d+$') THEN 'subway' ELSE 'tram' END WHEN t = 1 THEN 'subway'
 WHEN t IN (3, 11) OR t BETWEEN 800 AND 899 THEN 'bus'
 WHEN t = 2 THEN CASE WHEN regexp_matches(n, '^S\s?\d') THEN 'suburban' WHEN regexp_matches(n, '^(ICE|IC|ECE|EC|RJX|RJ|NJ|EN|TGV|FLX|D)\s?\d') THEN 'longdistance' ELSE 'regional' END
 WHEN t = 4 OR t BETWEEN 1000 AND 1099 OR t BETWEEN 1200 AND 1299 THEN 'ferry'
 WHEN t IN (5, 6, 7, 12, 405) OR t BETWEEN 1300 AND 1499 THEN 'cable' ELSE 'other' END"""


@query("x11_route_mode", duck(f"""
SELECT p_partkey, {_MODE_SQL} AS mode FROM (
  SELECT p_partkey, CASE WHEN p_size < 14 THEN p_size ELSE p_size * 30 END AS t, list_extract(['S1', 'ICE 29', 'RE 9', 'U2'], CAST(p_partkey % 4 + 1 AS INT)) AS n FROM {{part}})"""))
def x11(spark, d):
    kind = F.when(F.col("p_size") < 14, F.col("p_size")).otherwise(F.col("p_size") * 30)
    name = F.element_at(F.array(*[F.lit(x) for x in ("S1", "ICE 29", "RE 9", "U2")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.route_mode(kind, name).alias("mode"))


@query("x12_line_name", duck("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS name FROM {orders}"))
def x12(spark, d):
    short = F.when(F.col("o_custkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", text.line_name(short, F.col("o_orderpriority")).alias("name"))


@query("x14_choice_key", duck(f"SELECT trip_id, mode || '/' || {_slug_sql('line')} || '~' || {_slug_sql('CAST(agency AS VARCHAR)')} AS key FROM {{dv_trips}}"))
def x14(spark, d):
    return view(spark, d, "dv_trips").select("trip_id", text.choice_key(F.col("mode"), F.col("line"), F.col("agency").cast("string")).alias("key"))


@query("x15_compact", duck(f"SELECT p_partkey, array_to_string({_words_sql('p_name')}, '') AS compact FROM {{part}}"))
def x15(spark, d):
    return table(spark, d, "part").select("p_partkey", text.compact(F.col("p_name")).alias("compact"))


@query("x17_delay_text", duck("""
SELECT event_id, CASE WHEN delay IS NULL THEN '' WHEN m > 0 THEN '+' || CAST(m AS VARCHAR) WHEN m = 0 THEN '±0' ELSE '−' || CAST(-m AS VARCHAR) END AS shown,
  CASE WHEN delay IS NULL THEN 'none' WHEN m * 60 <= -60 THEN 'early' WHEN m * 60 < 120 THEN 'ok' WHEN m * 60 < 300 THEN 'minor' WHEN m * 60 < 600 THEN 'major' ELSE 'severe' END AS class
FROM (SELECT event_id, d AS delay, CAST(floor(d / 60.0e0 + 0.5e0) AS BIGINT) AS m FROM (SELECT event_id, (delay - 200) * 3 AS d FROM {dv_updates}))"""))
def x17(spark, d):
    delay = (F.col("delay") - 200) * 3
    m = (realtime.minutes(delay) / 60).cast("long")
    shown = F.when(m.isNull(), "").when(m > 0, F.concat(F.lit("+"), m.cast("string"))).when(m == 0, "±0").otherwise(F.concat(F.lit("−"), (-m).cast("string")))
    return view(spark, d, "dv_updates").select("event_id", shown.alias("shown"), realtime.delay_class(delay).alias("class"))


@query("x18_note_source", duck(r"SELECT doc_id, trim(regexp_replace(text, '\n{3,}', e'\n\n', 'g')) AS note FROM {documents}"))
def x18(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tidy_note(F.col("text")).alias("note"))


@query("x20_natural_order", duck(r"""
SELECT s_suppkey, array_to_string(list_transform(regexp_extract_all(lower(n), '\d+|\D+'), lambda r: CASE WHEN regexp_matches(r, '^\d') THEN lpad(r, 12, '0') ELSE r END), '') AS k
FROM (SELECT s_suppkey, 'Line ' || CAST(s_suppkey AS VARCHAR) || 'a' AS n FROM {supplier})"""))
def x20(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.natural_key(F.concat(F.lit("Line "), F.col("s_suppkey").cast("string"), F.lit("a"))).alias("k"))


@query("x21_is_newer", duck("SELECT o_orderkey, (o_custkey % 3, o_custkey % 12, o_orderkey % 5) > (1, 9, 2) AS newer FROM {orders}"))
def x21(spark, d):
    v = F.concat_ws(".", (F.col("o_custkey") % 3).cast("string"), (F.col("o_custkey") % 12).cast("string"), (F.col("o_orderkey") % 5).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", text.is_newer(F.concat(F.lit("v"), v), F.lit("1.9.2")).alias("newer"))


@query("x22_short_ip", duck("SELECT event_id, concat('10.', user_id % 256, '.7.0') AS ip FROM {events}"))
def x22(spark, d):
    ip = F.concat(F.lit("10."), (F.col("user_id") % 256).cast("string"), F.lit(".7."), (F.col("event_id") % 256).cast("string"))
    return table(spark, d, "events").select("event_id", text.short_ip(ip).alias("ip"))


@query("t01_service_day_start", duck("""
SELECT o_orderkey, CAST(epoch(((CAST(o_orderdate AS DATE) + INTERVAL 12 HOUR) AT TIME ZONE 'Europe/Berlin')) AS BIGINT) - 43200 AS start FROM {orders}"""))
def t01(spark, d):
    return table(spark, d, "orders").select("o_orderkey", time.service_day_start(F.col("o_orderdate").cast("date")).alias("start"))


@query("t02_local_clock", duck("""
SELECT o_orderkey, strftime(t, '%H%M') AS clock, CAST(t AS DATE) AS day FROM (
  SELECT o_orderkey, to_timestamp(1700000000 + o_orderkey * 7919) AT TIME ZONE 'Europe/Berlin' AS t FROM {orders})"""))
def t02(spark, d):
    e = F.lit(1_700_000_000) + F.col("o_orderkey") * 7919
    return table(spark, d, "orders").select("o_orderkey", time.local_clock(e).alias("clock"), time.local_date(e).alias("day"))


@query("t03_add_days_weekday", duck("SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_custkey % 9 AS INT) AS later, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM {orders}"))
def t03(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", time.add_days(day, (F.col("o_custkey") % 9).cast("int")).alias("later"), time.weekday(day).alias("weekday"))


@query("t04_parse_time", duck("SELECT trip_id, pos, CASE WHEN pos < 3 THEN arr_s END AS seconds FROM {dv_stop_times}"))
def t04(spark, d):
    s = F.col("arr_s")
    written = F.when(F.col("pos") < 3, F.format_string("%d:%02d:%02d", F.floor(s / 3600), (F.floor(s / 60) % 60), s % 60)).otherwise("")
    return view(spark, d, "dv_stop_times").select("trip_id", "pos", time.parse_time(written).alias("seconds"))


@query("m01_round_half_up", duck("SELECT c_custkey, CAST(floor(c_acctbal / 7 + 0.5e0) AS BIGINT) AS n, floor(c_acctbal / 3 * 1e5 + 0.5e0) / 1e5 AS r5 FROM {customer}"))
def m01(spark, d):
    return table(spark, d, "customer").select("c_custkey", geo.half_up(F.col("c_acctbal") / 7).alias("n"), geo.round5(F.col("c_acctbal") / 3).alias("r5"))


def _times_sql(h: str, m: int) -> str:
    return f"(({h} * {m & 0xFFFF} + (({h} * {m >> 16}) & 65535) * 65536) & 4294967295)"


@query("m02_mix", duck(f"""
SELECT k, h2 ^ (h2 >> 16) AS mixed FROM (
  SELECT k, {_times_sql('(xor(h1, h1 >> 13))', hashing.M2)} AS h2 FROM (
    SELECT o_orderkey AS k, {_times_sql('(xor(o_orderkey, o_orderkey >> 16))', hashing.M1)} AS h1 FROM {{orders}}))""".replace("h2 ^ (h2 >> 16)", "xor(h2, h2 >> 16)")))
def m02(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), hashing.mix(F.col("o_orderkey")).alias("mixed"))


_M = "sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(b.lat - a.lat, 2)) * 111320"


@query("m04_metres_bearing", duck(f"""
SELECT a.stop_id AS one, b.stop_id AS two, round({_M}, 3) AS m,
  CAST(floor(((degrees(atan2((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), b.lat - a.lat)) + 360) % 360) + 0.5e0) AS INT) AS bearing
FROM {{dv_stops}} a JOIN {{dv_stops}} b ON b.station_id = a.station_id AND a.stop_id <> b.stop_id"""))
def m04(spark, d):
    s = view(spark, d, "dv_stops")
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.station_id") == F.col("b.station_id")) & (F.col("a.stop_id") != F.col("b.stop_id")))
    p = [F.col(x) for x in ("a.lat", "a.lon", "b.lat", "b.lon")]
    return j.select(F.col("a.stop_id").alias("one"), F.col("b.stop_id").alias("two"), F.round(geo.metres(*p), 3).alias("m"), geo.bearing(*p).alias("bearing"))


@query("m06_weigh", duck("SELECT c_custkey, round(c_acctbal / pow((c_custkey % 50) * 0.3e0 + 0.1e0, 2), 6) AS w FROM {customer}"))
def m06(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(geo.weigh(F.col("c_acctbal"), (F.col("c_custkey") % 50) * F.lit(0.3)), 6).alias("w"))


@query("m07_web_mercator", duck("SELECT stop_id, round((lon + 180) / 360, 12) AS x, round((1 - ln(tan(pi() / 4 + radians(lat) / 2)) / pi()) / 2, 12) AS y FROM {dv_stops}"))
def m07(spark, d):
    return view(spark, d, "dv_stops").select("stop_id", F.round(geo.mercator_x(F.col("lon")), 12).alias("x"), F.round(geo.mercator_y(F.col("lat")), 12).alias("y"))


@query("m14_leaves_at", duck("""
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(coalesce(delay, 0) / 60.0e0 + 0.5e0) AS BIGINT) * 60 AS leaves,
  CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(coalesce(delay, 0) / 60.0e0 + 0.5e0) AS BIGINT) * 60) / 60.0e0) - floor(1704500000 / 60.0e0) AS BIGINT) AS minutes FROM {dv_updates}"""))
def m14(spark, d):
    planned = F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts"))
    leaves = realtime.leaves_at(planned, F.col("delay"))
    return view(spark, d, "dv_updates").select("event_id", leaves.alias("leaves"), realtime.until_minutes(leaves, F.lit(1_704_500_000)).alias("minutes"))


@query("m15_vehicle_spot", duck("""
SELECT trip_id, pos, CASE WHEN 40000 < arr_s THEN 'before' WHEN 40000 <= dep_s THEN 'at' ELSE 'after' END AS spot FROM {dv_stop_times}"""))
def m15(spark, d):
    now = F.lit(40_000)
    spot = F.when(now < F.col("arr_s"), "before").when(now <= F.col("dep_s"), "at").otherwise("after")
    return view(spark, d, "dv_stop_times").select("trip_id", "pos", spot.alias("spot"))


@query("m16_hop_key", duck("SELECT DISTINCT from_id, to_id, (2 * 25 + from_id) * 25 + to_id AS k FROM {dv_hops}"))
def m16(spark, d):
    return view(spark, d, "dv_hops").select("from_id", "to_id", ((F.lit(2) * 25 + F.col("from_id")) * 25 + F.col("to_id")).alias("k")).distinct()


@query("f06_bbox_filter", duck("SELECT stop_id, name FROM {dv_stops} WHERE lat BETWEEN 49.02 AND 49.06 AND lon BETWEEN 10.9 AND 10.99"))
def f06(spark, d):
    return view(spark, d, "dv_stops").where(geo.in_box(F.col("lat"), F.col("lon"), 49.02, 10.9, 49.06, 10.99)).select("stop_id", "name")


@query("f11_read_choice", duck("""
SELECT o_orderkey, list_distinct_keys AS keys FROM (
  SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN ['bus/' || lower(o_orderstatus), 'tram/x~y'] ELSE ['tram/x~y'] END AS list_distinct_keys FROM {orders})"""))
def f11(spark, d):
    typed = F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(" BUS/"), "o_orderstatus", F.lit(",tram/x~y,tram/x~y,zeppelin/1"))).otherwise(F.lit("a b,tram/x~y ,"))
    return table(spark, d, "orders").select("o_orderkey", text.read_choice(typed).alias("keys"))


@query("f12_active_period", duck("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN true ELSE (value <= 60 AND (event_id % 3 = 1 OR 60 < value + 30)) END AS active FROM {events}"))
def f12(spark, d):
    v = F.col("value")
    end = F.when(F.col("event_id") % 3 == 1, F.lit(0.0)).otherwise(v + 30)
    none = F.array().cast("array<struct<start:double,end:double>>")
    periods = F.when(F.col("event_id") % 3 == 0, none).otherwise(F.array(F.struct(v.alias("start"), end.alias("end"))))
    return table(spark, d, "events").select("event_id", realtime.is_active(periods, F.lit(60.0)).alias("active"))


@query("f13_plausible_delay", duck("SELECT event_id, CASE WHEN abs(d) <= 21600 THEN d END AS delay FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(floor(value * 90) AS BIGINT) ELSE delay END AS d FROM (SELECT u.event_id, e.value, u.delay FROM {dv_updates} u JOIN {events} e ON e.event_id = u.event_id))"))
def f13(spark, d):
    j = view(spark, d, "dv_updates").join(table(spark, d, "events").select("event_id", "value"), "event_id")
    scheduled = F.col("event_id") * 10
    reported = F.when(F.col("event_id") % 2 == 0, scheduled + F.floor(F.col("value") * 90))
    return j.select("event_id", realtime.event_delay(reported, F.col("delay"), scheduled).alias("delay"))


@query("f17_left_already", duck("SELECT trip_id, pos FROM {dv_stop_times} WHERE dep_s < 40000 - 30"))
def f17(spark, d):
    return view(spark, d, "dv_stop_times").where(realtime.left_already(F.col("dep_s"), F.lit(None).cast("int"), F.lit(40_000))).select("trip_id", "pos")


@query("f18_visit_filter", duck("SELECT event_id FROM {events} WHERE event_type IN ('click', 'view') AND user_id % 4 <> 0"))
def f18(spark, d):
    e = table(spark, d, "events")
    method = F.when(F.col("event_type").isin("click", "view"), "GET").otherwise("POST")
    refused = F.col("user_id") % 4 == 0
    return e.where((method == "GET") & ~refused).select("event_id")


@query("u08_choice_toggle", duck("""
SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN ['bus/1~a'] WHEN o_custkey % 3 = 1 THEN ['bus/1~b', 'tram/2'] ELSE ['tram/2', 'bus/1~a'] END AS keys FROM {orders}"""))
def u08(spark, d):
    k = F.col("o_custkey") % 3
    none = F.array().cast("array<string>")
    chosen = F.when(k == 0, none).when(k == 1, F.array(F.lit("bus/1"), F.lit("tram/2"))).otherwise(F.array(F.lit("tram/2")))
    every = F.array(F.lit("bus/1~a"), F.lit("bus/1~b"), F.lit("tram/2~c"))
    return table(spark, d, "orders").select("o_orderkey", text.toggled(chosen, F.lit("bus/1~a"), every).alias("keys"))


@query("f10_choice_filter", duck("SELECT trip_id FROM {dv_trips} WHERE mode = 'bus' OR (mode = 'tram' AND agency = 3)"))
def f10(spark, d):
    keys = F.array(F.lit("bus/x"), F.lit("tram/x~3"))
    return view(spark, d, "dv_trips").where(text.in_choice(keys, F.col("mode"), F.lit("x"), F.col("agency").cast("string"))).select("trip_id")


@query("o07_hilbert_order", duck("""
WITH RECURSIVE p AS (SELECT stop_id, CAST(floor(lat * 1e5 + 0.5e0) AS BIGINT) AS lat5, CAST(floor(lon * 1e5 + 0.5e0) AS BIGINT) AS lon5 FROM {dv_stops}),
w AS (
  SELECT stop_id, lon5 + 18000000 AS x, lat5 + 9000000 AS y, CAST(0 AS BIGINT) AS along, 25 AS b FROM p
  UNION ALL
  SELECT stop_id, CASE WHEN ry = 1 THEN x WHEN rx = 1 THEN 67108863 - y ELSE y END, CASE WHEN ry = 1 THEN y WHEN rx = 1 THEN 67108863 - x ELSE x END, along * 4 + xor(3 * rx, ry), b - 1
  FROM (SELECT *, (x >> b) & 1 AS rx, (y >> b) & 1 AS ry FROM w WHERE b >= 0) v
)
SELECT stop_id, lat5, lon5, along FROM p JOIN w USING (stop_id) WHERE b = -1"""))
def o07(spark, d):
    """Places in curve order."""
    s = view(spark, d, "dv_stops").select("stop_id", geo.half_up(F.col("lat") * 1e5).alias("lat5"), geo.half_up(F.col("lon") * 1e5).alias("lon5"))
    return s.withColumn("along", geo.curve_of(F.col("lat5"), F.col("lon5"))).orderBy("along", "stop_id")


@query("m03_shared_lists", duck("SELECT trip_id, min(trip_id) OVER (PARTITION BY l) AS id FROM (SELECT trip_id, list(stop_id ORDER BY pos) AS l FROM {dv_stop_times} GROUP BY trip_id)"))
def m03(spark, d):
    """The trips of each list of stops, by the list's hash, told apart where hashes collide."""
    l = view(spark, d, "dv_stop_times").groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop_id"))), lambda x: x["stop_id"]).alias("l"))
    return shared_lists(l, "trip_id", "l").select("trip_id", "id")
