"""A timetable derived from the star-schema tables in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.derived import derived

ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity"

VIEWS = {
    "dv_stops": """
SELECT n_nationkey AS stop_id, n_name AS name, 49.0e0 + 0.02e0 * (n_nationkey % 5) AS lat, 10.9e0 + 0.03e0 * floor(n_nationkey / 5) AS lon,
       n_nationkey - (n_nationkey % 2) AS station_id, n_regionkey AS town_id, (n_nationkey % 5) <= 2 AS in_region FROM {nation}""",
    "dv_stop_times": f"""
SELECT l_orderkey AS trip_id, CAST(rn - 1 AS int) AS pos, CAST(l_suppkey % 25 AS int) AS stop_id,
       CAST(st + q - q0 AS int) AS arr_s, CAST(st + q - q0 + 30 * (l_partkey % 3) AS int) AS dep_s, CAST(n - 1 AS int) AS last_pos
FROM (SELECT *, (l_orderkey % 24) * 3750 AS st, row_number() OVER w AS rn,
        sum(60 * CAST(l_quantity AS int)) OVER (PARTITION BY l_orderkey ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS q,
        60 * first_value(CAST(l_quantity AS int)) OVER w AS q0, count(*) OVER (PARTITION BY l_orderkey) AS n
      FROM {{lineitem}} WINDOW w AS (PARTITION BY l_orderkey ORDER BY {ORDER})) x
WHERE n >= 2""",
    "dv_trips": """
SELECT o_orderkey AS trip_id, o_orderpriority AS line, CASE o_orderstatus WHEN 'F' THEN 'tram' WHEN 'O' THEN 'bus' ELSE 'regional' END AS mode,
       o_custkey % 7 AS agency, CAST(o_orderdate AS date) AS service_date
FROM {orders} WHERE o_orderkey IN (SELECT trip_id FROM {dv_stop_times})""",
    "dv_updates": """
SELECT event_id, user_id AS trip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos, event_type,
       CASE WHEN event_type IN ('purchase', 'click') THEN CAST(floor(value) AS int) END AS delay, ts FROM {events}""",
    "dv_hops": """
SELECT trip_id, pos, from_id, stop_id AS to_id, from_dep, arr_s AS to_arr
FROM (SELECT *, lag(stop_id) OVER w AS from_id, lag(dep_s) OVER w AS from_dep FROM {dv_stop_times} WINDOW w AS (PARTITION BY trip_id ORDER BY pos)) h
WHERE from_id <> stop_id""",
}


TABLES = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def names_in(text: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", text)) if n in TABLES or n in VIEWS]


ONCE = {"dv_stop_times", "dv_trips", "dv_hops"}


def tables_of(name: str) -> set[str]:
    """The tables that a view, or a table, is derived from."""
    return {name} if name not in VIEWS else {t for n in names_in(VIEWS[name]) for t in tables_of(n)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table, as a DataFrame. Calls, trips and hops, which nearly all queries are over, are derived once and read back for as long as
    the files of their tables and the text of the view stay the same."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)

    def make() -> DataFrame:
        return spark.sql(VIEWS[name], **{n: view(spark, sf_dir, n) for n in names_in(VIEWS[name])})

    if name not in ONCE:
        return make()
    version = hashlib.sha256(duck(f"SELECT * FROM {{{name}}}").encode()).hexdigest()[:16]
    return derived(spark, name, [f"{sf_dir}/{t}.parquet" for t in sorted(tables_of(name))], make, version)[0]


def duck(text: str) -> str:
    """SQL over tables and derived views in braces as one DuckDB statement."""
    ctes: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in ctes:
            for n in names_in(VIEWS[name]):
                add(n)
            ctes[name] = VIEWS[name].format(**{n: n for n in names_in(VIEWS[name])})

    for n in names_in(text):
        add(n)
    body = re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES or m[1] in VIEWS else m[0], text).strip()
    head = ",\n".join(f"{n} AS ({t.strip()})" for n, t in ctes.items())
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    if recursive:
        return f"WITH RECURSIVE {head + ',' if head else ''}\n{body[recursive.end():]}"
    plain = re.match(r"WITH\s+", body, re.I)
    if plain:
        return f"WITH {head + ',' if head else ''}\n{body[plain.end():]}"
    return f"WITH {head}\n{body}" if head else body
