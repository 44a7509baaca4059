"""Search queries over part and customer names and the derived stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import joins, map_view, search
from ..operators.tables import materialise
from ..sources.derived import derived
from .registry import query
from .transit import duck, table, view

_WORDS = r"list_filter(string_split_regex(strip_accents(replace(lower({0}), 'ß', 'ss')), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_PW = _WORDS.format("p_name")


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size")


@query("v01_tokenise_names", duck(f"SELECT p_partkey, unnest(list_distinct({_PW})) AS word FROM {{part}}"))
def v01(spark, d):
    return search.tokens(_parts(spark, d), "p_partkey", "p_name").select("p_partkey", "word")


def _level(typed: str) -> str:
    return f"CASE WHEN starts_with(w, '{typed}') THEN 0 WHEN contains(w, '{typed}') THEN 1 END"


@query("v06_match_levels", duck(f"SELECT p_partkey, min({_level('ar')}) AS level FROM (SELECT p_partkey, unnest({_PW}) AS w FROM {{part}}) GROUP BY p_partkey HAVING min({_level('ar')}) IS NOT NULL"))
def v06(spark, d):
    t = search.tokens(_parts(spark, d), "p_partkey", "p_name").withColumn("level", search.level_of(F.col("word"), "ar"))
    return t.groupBy("p_partkey").agg(F.min("level").alias("level")).where("level IS NOT NULL")


@query("v04_substring_scan", duck("SELECT p_partkey, CAST(instr(lower(p_name), 'ar') AS INT) AS at FROM {part} WHERE instr(lower(p_name), 'ar') > 0"))
def v04(spark, d):
    at = F.instr(F.lower("p_name"), "ar")
    return _parts(spark, d).where(at > 0).select("p_partkey", at.alias("at"))


@query("q37_search_stops", duck(f"""
WITH m AS (SELECT p_partkey, min({_level('ar')}) AS level FROM (SELECT p_partkey, unnest({_PW}) AS w FROM {{part}}) GROUP BY p_partkey)
SELECT m.p_partkey, level, p_size FROM m JOIN {{part}} p ON p.p_partkey = m.p_partkey WHERE level IS NOT NULL ORDER BY level, p_size DESC, p_partkey LIMIT 20"""))
def q37(spark, d):
    return search.search_stops(search.tokens(_parts(spark, d), "p_partkey", "p_name"), _parts(spark, d), "p_partkey", "ar", "p_size")


def _index(spark, d):
    """The stored index of the parts' names, made again when they change."""
    make = lambda: search.index(search.tokens(_parts(spark, d), "p_partkey", "p_name"), "p_partkey")
    return derived(spark, "part_index", [f"{d}/part.parquet"], make, by=["letter"])[0]


@query("v02_stored_index", duck(f"""
WITH w AS (SELECT p_partkey, unnest(list_distinct({_PW})) AS word FROM {{part}}), l AS (SELECT p_partkey, word, unnest(list_distinct(string_split(word, ''))) AS c FROM w)
SELECT CASE WHEN regexp_matches(c, '[a-z0-9]') THEN c ELSE '_' END AS letter, count(*) AS entries, count(DISTINCT word) AS words FROM l GROUP BY 1"""))
def v02(spark, d):
    """What each part of the index holds."""
    return _index(spark, d).groupBy("letter").agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("word").alias("words"))


def _rung(w: str, typed: str, slips: int) -> str:
    near = f"WHEN {w}[1] = '{typed[0]}' AND len(list_filter(range({len(typed) - slips}, {len(typed) + slips + 1}), lambda n: damerau_levenshtein({w}[:n], '{typed}') <= {slips})) > 0 THEN 2" if slips else ""
    return f"CASE WHEN starts_with({w}, '{typed}') THEN 0 WHEN contains({w}, '{typed}') THEN 1 {near} END"


def _ladder(one: str, two: str) -> str:
    level = [f"min({_rung('w', t, search.slips_of(t))})" for t in (one, two)]
    return duck(f"""
WITH m AS (SELECT p_partkey, greatest({level[0]}, {level[1]}) AS level FROM (SELECT p_partkey, unnest({_PW}) AS w FROM {{part}}) GROUP BY p_partkey HAVING {level[0]} IS NOT NULL AND {level[1]} IS NOT NULL)
SELECT m.p_partkey, level, p_size FROM m JOIN {{part}} p ON p.p_partkey = m.p_partkey WHERE level < 2 OR (SELECT min(level) FROM m) = 2 ORDER BY level, p_size DESC, p_partkey LIMIT 20""")


@query("v10_search_ladder", _ladder("smlal", "bo"))
def v10(spark, d):
    """Two typed words, one with a slip, from the stored index: two of its parts are read."""
    return search.search_stops(_index(spark, d), _parts(spark, d), "p_partkey", "smlal bo", "p_size")


@query("q38_nearly_begins", duck(f"""
WITH w AS (SELECT p_partkey, ({_PW})[1] AS word FROM {{part}}),
l AS (SELECT *, CASE WHEN starts_with(word, 'smlal') THEN 0 WHEN contains(word, 'smlal') THEN 1
  WHEN word[1] = 's' AND len(list_filter(range(4, 7), lambda n: damerau_levenshtein(word[:n], 'smlal') <= 1)) > 0 THEN 2 END AS level FROM w)
SELECT p_partkey, word, level FROM l WHERE level IS NOT NULL"""))
def q38(spark, d):
    """Names with a slip of the finger."""
    first = search.tokens(_parts(spark, d), "p_partkey", "p_name").where("n = 0").select("p_partkey", "word")
    return first.withColumn("level", search.level_of(F.col("word"), "smlal")).where("level IS NOT NULL")


@query("q39_search_towns", duck("SELECT r_regionkey, lower(r_name) = 'asia' AS exact FROM {region} WHERE starts_with(lower(r_name), 'asia')"))
def q39(spark, d):
    return search.search_towns(table(spark, d, "region"), "r_regionkey", "r_name", "Asia")


@query("q40_search_lines", duck("SELECT c_custkey, 0 AS exact FROM {customer} WHERE starts_with(array_to_string(" + _WORDS.format("c_name") + ", ''), 'customer0000001')"))
def q40(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.lit("bus").alias("mode"))
    return search.search_lines(c, "c_custkey", "c_name", "mode", "Customer#0000001")


_M = "sqrt(pow((b.lon - a.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + pow(b.lat - a.lat, 2)) * 111320"


@query("q41_nearby_suggestions", duck(f"""
WITH c AS (SELECT stop_id, count(*) AS c FROM {{dv_stop_times}} GROUP BY stop_id), s AS (SELECT a.stop_id, a.lat, a.lon, sum(c) AS score FROM {{dv_stops}} a JOIN {{dv_stops}} b ON {_M} <= 3000 JOIN c ON c.stop_id = b.stop_id GROUP BY ALL)
SELECT stop_id, score FROM s ORDER BY score DESC, stop_id LIMIT 5"""))
def q41(spark, d):
    s = view(spark, d, "dv_stops")
    c = view(spark, d, "dv_stop_times").groupBy("stop_id").agg(F.count(F.lit(1)).alias("c"))
    b = s.join(c, "stop_id").select(F.col("stop_id").alias("two"), "lat", "lon", "c")
    near = joins.within(s.select("stop_id", F.col("lat").alias("y"), F.col("lon").alias("x")), b, 3_000, ("y", "x"), ("lat", "lon"))
    return near.groupBy("stop_id").agg(F.sum("c").alias("score")).orderBy(F.desc("score"), "stop_id").limit(5)


@query("v07_match_through_town", duck(f"""
WITH o AS (SELECT n_nationkey, min(CASE WHEN starts_with(w, 'in') THEN 0 WHEN contains(w, 'in') THEN 1 END) AS own FROM (SELECT n_nationkey, unnest({_WORDS.format('n_name')}) AS w FROM {{nation}}) GROUP BY n_nationkey)
SELECT n.n_nationkey, least(coalesce(own, 9), CASE WHEN r_name = 'ASIA' THEN 0 ELSE 9 END) AS level FROM {{nation}} n JOIN {{region}} ON r_regionkey = n_regionkey JOIN o ON o.n_nationkey = n.n_nationkey WHERE least(coalesce(own, 9), CASE WHEN r_name = 'ASIA' THEN 0 ELSE 9 END) < 9"""))
def v07(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = search.tokens(n, "n_nationkey", "n_name").groupBy("n_nationkey").agg(F.min(search.level_of(F.col("word"), "in")).alias("own"))
    level = F.least(F.coalesce("own", F.lit(9)), F.when(F.col("r_name") == "ASIA", 0).otherwise(9))
    return n.join(own, "n_nationkey", "left").select("n_nationkey", level.alias("level")).where("level < 9")


@query("k07_search_list", duck("""
WITH p AS (SELECT stop_id, name, CAST(floor(lat * 1e5 + 0.5e0) AS BIGINT) AS v FROM {dv_stops})
SELECT stop_id, row_number() OVER (ORDER BY stop_id) AS rank, name, v - coalesce(lag(v) OVER (ORDER BY stop_id), 0) AS dlat FROM p"""))
def k07(spark, d):
    """The columns of the search list, row by row: names in order, latitudes as steps from the row before, which is met by its rank."""
    s = view(spark, d, "dv_stops").select("stop_id", "name", geo.half_up(F.col("lat") * 1e5).alias("v"))
    s = materialise(map_view.global_rank(s, ["stop_id"]), "list")
    before = s.select((F.col("rank") + 1).alias("rank"), F.col("v").alias("_b"))
    return s.join(before, "rank", "left").select("stop_id", "rank", "name", (F.col("v") - F.coalesce("_b", F.lit(0))).alias("dlat"))
