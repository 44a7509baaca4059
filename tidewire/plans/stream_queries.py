"""Realtime semantics as streams over the events table, each run to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import sets
from ..operators.tables import shared_dir
from ..streaming import realtime
from .registry import query
from .transit import duck, table


def _updates(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "NO_DATA").otherwise("SCHEDULED")
    delay = F.when(F.col("event_type").isin("purchase", "click"), F.floor("value").cast("int"))
    return e.select(F.col("user_id").alias("trip_id"), F.col("ts").cast("date").alias("service_date"), (F.col("event_id") % 4).cast("int").alias("pos"), kind.alias("kind"), delay.alias("delay"), F.col("ts").cast("timestamp").alias("feed_ts"), "event_id")


def _stream(spark, parts, late: str, at: str = "feed_ts"):
    """(stream, folder) of tables that arrive one after the other, each as one file."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    for part in parts:
        part.repartition(1).write.mode("append").parquet(f"{base}/in")  # many tasks make the rows, one writes them
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").withWatermark(at, late), base


def _keys(spark, parts, late: str, ttl_s: float | None):
    """What keyed state holds at the stream's end."""
    stream, base = _stream(spark, parts, late)
    with realtime.rocks(spark):
        query = realtime.keep_keys(realtime.newest(stream, ttl_s), f"{base}/out", f"{base}/check", once=True)
        query.awaitTermination()
    return realtime.current(spark, f"{base}/out")["keys"]


@query("g03_snapshot_replace", duck("SELECT user_id AS trip_id, CAST(count(*) AS INT) AS delay FROM {events} WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM {events}) GROUP BY user_id"))
def g03(spark, d):
    """Two snapshots in a row, all days but the last and the last: what stays is the second, whole."""
    e = table(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    newest = F.broadcast(e.agg(F.max("day").alias("last")))  # one row
    n = e.crossJoin(newest).groupBy("user_id", (F.col("day") == F.col("last")).alias("now")).agg(F.count(F.lit(1)).cast("int").alias("delay"), F.max("last").alias("last"))
    at = F.when(F.col("now"), F.col("last")).otherwise(F.date_sub("last", 1)).cast("timestamp")
    rows = n.select(F.col("user_id").cast("long").alias("trip_id"), F.col("last").alias("service_date"), F.lit(0).alias("pos"), F.lit("SCHEDULED").alias("kind"), "delay", at.alias("feed_ts"), "now")
    stream, base = _stream(spark, [rows.where("NOT now").drop("now"), rows.where("now").drop("now")], "6 hours")
    realtime.keep_current(stream, f"{base}/out", f"{base}/check", once=True).awaitTermination()
    return realtime.current(spark, f"{base}/out")["delays"].select("trip_id", F.col("dep_delay").alias("delay"))


@query("g04_stale_state", duck("SELECT user_id, max(event_id) AS event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last, max(ts) OVER () AS top FROM {events}) WHERE ts = last AND date_trunc('milliseconds', last) > date_trunc('milliseconds', top) - INTERVAL 180 MINUTE GROUP BY user_id"))
def g04(spark, d):
    """The users whose newest event keyed state still holds, three hours of event time being its time to live."""
    m = realtime.as_messages(table(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id")
    half = m.agg(F.percentile_approx("feed_ts", 0.5)).first()[0]
    held = _keys(spark, [m.where(F.col("feed_ts") <= F.lit(half)), m.where(F.col("feed_ts") > F.lit(half))], "0 seconds", 180 * 60)
    return held.select(F.get_json_object("key", "$.user_id").cast("long").alias("user_id"), F.col("version").alias("event_id"))


@query("g05_last_write_wins", duck("""
SELECT user_id AS trip_id, CAST(ts AS DATE) AS service_date, max_by(CASE WHEN event_type = 'error' THEN 'NO_DATA' ELSE 'SCHEDULED' END, {'t': ts, 'v': event_id}) AS kind, max_by(event_id, {'t': ts, 'v': event_id}) AS event_id FROM {events} GROUP BY ALL""".replace("{'t': ts, 'v': event_id}", "row(ts, event_id)")))
def g05(spark, d):
    """The last message of every trip and date, messages arriving in three files out of order, one of them twice."""
    u = _updates(spark, d).select("trip_id", "service_date", "kind", "feed_ts", "event_id")
    m = realtime.as_messages(u, ["trip_id", "service_date"], "feed_ts", "event_id")
    parts = [m.where(F.pmod("version", F.lit(3)) == i) for i in (2, 0, 1)]
    held = _keys(spark, [parts[0].unionByName(parts[0]), *parts[1:]], "60 days", None)
    key = F.from_json("key", "trip_id long, service_date date")
    return held.select(key["trip_id"].alias("trip_id"), key["service_date"].alias("service_date"), F.get_json_object("value", "$.kind").alias("kind"), F.col("version").alias("event_id"))


@query("g07_matched_count", duck("SELECT count(*) AS matched FROM {events} WHERE user_id IN (SELECT l_orderkey FROM {lineitem})"))
def g07(spark, d):
    """What the running query observes of updates whose trip the timetable has, summed over its micro-batches."""
    k = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("user_id")).distinct()
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    stream, base = _stream(spark, [e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1")], "6 hours", "ts")
    known = stream.join(k, "user_id", "left_semi").observe("live", F.count(F.lit(1)).alias("matched"))
    query = known.writeStream.format("noop").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = [p["observedMetrics"]["live"]["matched"] for p in query.recentProgress if "live" in p["observedMetrics"]]
    return spark.createDataFrame([(sum(seen),)], "matched long")


@query("g08_late_window", duck("""
WITH e AS (SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS w, event_id % 3 = 0 AS late FROM {events}), m AS (SELECT epoch(date_trunc('milliseconds', max(ts))) - 21600 AS mark FROM {events} WHERE event_id % 3 <> 0)
SELECT w, count(*) AS n FROM e, m WHERE NOT late OR (w + 1) * 21600 > mark GROUP BY w"""))
def g08(spark, d):
    """Rows a window of six hours where a third of them comes after all others: those of windows that ended six hours before the newest so far are too late."""
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 3 == 0).alias("late"))
    # a batch drops what was late for the one before it, so one without rows comes between
    stream, base = _stream(spark, [e.where(x).drop("late") for x in ("NOT late", "false", "late")], "6 hours", "ts")
    counts = stream.groupBy(F.window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))

    def add(batch, number):
        batch.select(F.col("window.start").alias("at"), "n").write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    counts.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{base}/out").groupBy("at").agg(F.max_by("n", "batch").alias("n"))
    return last.select(F.floor(F.unix_seconds("at") / 21_600).alias("w"), "n")


@query("q34_stream_snapshot", duck("""
WITH e AS (
  SELECT user_id AS trip_id, CAST(ts AS DATE) AS service_date, CAST(event_id % 4 AS INT) AS pos,
    arg_max({'no': event_type = 'error', 'p': CASE WHEN event_type IN ('purchase', 'click') AND abs(floor(value)) <= 21600 THEN CAST(floor(value) AS INT) END}, event_id) AS v
  FROM {events} GROUP BY ALL
), g AS (SELECT *, v.no AS no, v.p AS p, sum(CASE WHEN v.no THEN 1 ELSE 0 END) OVER (PARTITION BY trip_id, service_date ORDER BY pos ROWS UNBOUNDED PRECEDING) AS grp FROM e)
SELECT trip_id, service_date, pos,
  CASE WHEN NOT no THEN coalesce(last_value(CASE WHEN NOT no THEN p END IGNORE NULLS) OVER (PARTITION BY trip_id, service_date, grp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), p) END AS arr_delay,
  CASE WHEN NOT no THEN last_value(CASE WHEN NOT no THEN p END IGNORE NULLS) OVER (PARTITION BY trip_id, service_date, grp ORDER BY pos ROWS UNBOUNDED PRECEDING) END AS dep_delay
FROM g"""))
def q34(spark, d):
    """The stream run to its end over two snapshot files, the first of which has only part of the calls: what stays is the second one's delays."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    u = sets.last_wins(_updates(spark, d).drop("feed_ts"), ["trip_id", "service_date", "pos"], "event_id").select("trip_id", "service_date", "pos", "kind", "delay")
    for n, part in enumerate(("pos < 2", "pos >= 0")):
        rows = u.where(part).withColumn("feed_ts", F.lit(f"2024-02-01 00:0{n}:00").cast("timestamp"))
        realtime.latest(rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
    query = realtime.keep_current(realtime.read_updates(spark, f"{base}/in"), f"{base}/out", f"{base}/check", once=True)
    query.awaitTermination()
    return realtime.current(spark, f"{base}/out")["delays"].select("trip_id", "service_date", "pos", "arr_delay", "dep_delay")
