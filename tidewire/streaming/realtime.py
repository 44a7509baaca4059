"""Live delays as a stream: every snapshot replaces the state, which ages; and keyed state where messages come one by one."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import realtime as said
from ..operators import aggregates as ag
from ..operators import sequences as seq
from ..sources import files, gtfs_rt
from ..sources.derived import files as listed

STALE_S = 180
KEPT = 10  # versions of a state: a reader that began with one may go on for so many swaps
UPDATES = "trip_id BIGINT, service_date DATE, pos INT, kind STRING, delay INT, feed_ts TIMESTAMP"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_updates(spark: SparkSession, folder: str, schema: str = UPDATES, late: str = "6 hours") -> DataFrame:
    """New snapshot files of the folder, with the bound for late ones."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("feed_ts", late)


def read_messages(spark: SparkSession, folder: str) -> DataFrame:
    """New protobuf messages of a folder in any store that Spark reads, one a micro-batch, for keep_live."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", 1).load(folder).select("content")


def latest(updates: DataFrame) -> DataFrame:
    """(trip_id, service_date, pos) with what the newest message says; works on a stream and on a table."""
    newest = F.max_by(F.struct("kind", "delay"), "feed_ts")
    return updates.groupBy("trip_id", "service_date", "pos").agg(newest.alias("_v"), F.max("feed_ts").alias("feed_ts")).select("trip_id", "service_date", "pos", "_v.kind", "_v.delay", "feed_ts")


def delays(updates: DataFrame) -> DataFrame:
    """Carried delays of one snapshot."""
    plausible = F.when(F.abs("delay") <= 21_600, F.col("delay"))
    out = seq.carry_forward(updates, ["trip_id", "service_date"], "pos", F.lit(None).cast("int"), plausible, F.col("kind") == "NO_DATA")
    return out.select("trip_id", "service_date", "pos", "arr_delay", "dep_delay", "feed_ts")


# --- versions: a state that readers never meet half-written ---


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The whole versions of a state, oldest first: those whose head, which is written last, is there."""
    return sorted({int(p.split("/v=")[-1].split("/")[0]) for p, _, _ in listed(spark, [folder]) if "/meta/_SUCCESS" in p})


def swap(spark: SparkSession, folder: str, tables: dict[str, DataFrame], number: int, kept: int = KEPT) -> None:
    """Write tables as the version number of the state, which becomes the current one when it is whole; versions before the last kept ones go. A
    batch that is run again writes its version again."""
    files.write_dataset(tables, f"{folder}/v={number:012d}", "state")
    for old in versions(spark, folder)[:-kept]:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v={old:012d}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def current(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables of the newest whole version; none before the first."""
    found = versions(spark, folder)
    return files.read_dataset(spark, f"{folder}/v={found[-1]:012d}", "state") if found else None


def _start(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def keep_current(updates: DataFrame, folder: str, checkpoint: str, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Keeps the newest snapshot's delays as the state's table delays: the newest snapshot is the whole state, an older one that comes late changes nothing,
    and a failed fetch keeps what there is."""

    def replace(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = batch.agg(F.max("feed_ts")).first()[0]
        held = current(spark, folder)
        before = held["delays"].agg(F.max("feed_ts")).first()[0] if held else None
        if newest is not None and (before is None or newest >= before):
            rows = batch.where(F.col("feed_ts") == F.lit(newest))
            swap(spark, folder, {"delays": delays(rows).withColumn("batch", F.lit(number))}, number)

    return _start(updates, replace, checkpoint, every, once)


def keep_live(messages: DataFrame, trips: DataFrame, hops: DataFrame, folder: str, checkpoint: str, now: Callable[[], int], language: str = "de", every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Keeps what the newest message says of the timetable as a state of three tables, swapped together.

    trips (trip_id) is the timetable, hops (trip_id, pos, from_id, to_id, stop_id) its ways. delays: (trip_id, pos, delay), departures' delays carried
    along each known trip, the same for trips that share a hop. notes: (trip_id, stop_id, title, text, warning) of the alerts that hold now, warnings
    first by sort, each text once a trip or stop. status: feed_ts, and how many of the message's trips the
    timetable has (matched)."""

    def replace(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = gtfs_rt.updates_of(batch)
        newest = rows.agg(F.max("feed_ts")).first()[0]
        held = current(spark, folder)
        before = held["status"].first()["feed_ts"] if held else None
        if newest is None or (before is not None and newest < before):
            return
        rows = rows.where(F.col("feed_ts") == newest)
        known = rows.select("trip_id").distinct().join(trips.select("trip_id"), "trip_id", "left_semi")
        own = rows.join(known, "trip_id").select("trip_id", F.col("stop_seq").alias("pos"), F.when(F.abs("dep_delay") <= 21_600, F.col("dep_delay")).alias("delay"), (F.col("relation") == 2).alias("none"))
        way = hops.join(own.select("trip_id").distinct(), "trip_id", "left_semi").join(own, ["trip_id", "pos"], "left")
        carried = seq.carry_forward(way, ["trip_id"], "pos", F.lit(None).cast("int"), F.col("delay"), F.coalesce(F.col("none"), F.lit(False)))
        carried = carried.select("trip_id", "pos", "from_id", "to_id", F.col("dep_delay").alias("delay"))
        agreed = ag.agreed(carried.where("delay IS NOT NULL").withColumn("own", F.lit(True)), ["from_id", "to_id"], "delay", "own")
        shared = carried.join(agreed, ["from_id", "to_id"], "left").select("trip_id", "pos", F.coalesce("agreed", "delay").alias("delay"))
        alerts = gtfs_rt.alerts_of(batch, language)
        holds = (F.size("periods") == 0) | said.is_active(F.col("periods"), F.lit(now()))
        about = alerts.where(holds & F.coalesce("text", "title").isNotNull()).join(trips.select("trip_id").withColumn("_known", F.lit(True)), "trip_id", "left")
        notes = about.where(F.col("_known") | F.col("stop_id").isNotNull()).groupBy("trip_id", "stop_id", "title", "text").agg(F.max("warning").alias("warning"))
        swap(spark, folder, {"delays": shared, "notes": notes.sort(F.desc("warning")), "status": known.agg(F.count(F.lit(1)).alias("matched")).withColumn("feed_ts", F.lit(newest))}, number)

    return _start(messages, replace, checkpoint, every, once)


def fresh(state: DataFrame, now: str) -> DataFrame:
    """The state while it is at most STALE_S old; after that only the timetable counts."""
    return state.where(F.col("feed_ts") >= F.to_timestamp(F.lit(now)) - F.expr(f"INTERVAL '{STALE_S}' SECOND"))


# --- keyed state: messages one by one ---


class Newest(StatefulProcessor):
    """Of each key what its newest message says, until it is ttl_s old by the stream's event time."""

    def __init__(self, ttl_s: float):
        self.ttl_ms = int(ttl_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "at long, version long, rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        at = frame["feed_ts"].astype("datetime64[us]").astype("int64")
        last = max(zip(at, frame["version"], strict=True))
        held = self.held.get() if self.held.exists() else None
        if held is not None and (held[0], held[1]) >= last:
            return  # late or repeated: what is held is as new
        newest = frame[(at == last[0]) & (frame["version"] == last[1])]
        ends = last[0] // 1000 + self.ttl_ms
        if ends <= timerValues.getCurrentWatermarkInMs():
            return  # too old already
        if held is not None:
            self.handle.deleteTimer(held[0] // 1000 + self.ttl_ms)
        self.handle.registerTimer(ends)
        self.held.update((int(last[0]), int(last[1]), ""))
        yield self._out(key, newest["feed_ts"].iloc[0], int(last[1]), newest["value"].iloc[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        self.held.clear()
        yield self._out(key, pd.Timestamp(held[0], unit="us"), int(held[1]), None, True)

    def _out(self, key, at, version, value, gone) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "feed_ts": [at], "version": [version], "value": [value], "gone": [gone]})

    def close(self) -> None:
        pass


def newest(messages: DataFrame, ttl_s: float | None = STALE_S) -> DataFrame:
    """The stream of changes (key, feed_ts, version, value, gone) of messages (key string, feed_ts timestamp with a watermark, version long, value
    string): a row whenever a later message, by feed_ts and then version, replaces what is held of its key, and one with gone where what is held
    has become ttl_s old (None: never). A late or repeated message changes nothing. Keys are dealt out; of each a task holds one row.

    What never ages needs no timers, so it is a streaming maximum without Python; it says again what is held of a key whose messages changed nothing."""
    m = messages.select("key", "feed_ts", "version", "value")
    if ttl_s is None:
        held = m.groupBy("key").agg(F.max(F.struct("feed_ts", "version", "value")).alias("_v"))
        return held.select("key", "_v.feed_ts", "_v.version", "_v.value", F.lit(False).alias("gone"))
    out = "key string, feed_ts timestamp, version long, value string, gone boolean"
    return m.groupBy("key").transformWithStateInPandas(Newest(ttl_s), out, "Update", "EventTime")


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """While a query with keyed state is started: the store that it needs, the session's setting put back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_keys(changes: DataFrame, folder: str, checkpoint: str, every: str = "60 seconds", once: bool = False) -> StreamingQuery:
    """Keeps the table keys of a state as newest's changes say. Started within rocks."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy("key").agg(F.max_by(F.struct("feed_ts", "version", "value", "gone"), F.struct(F.col("feed_ts"), F.col("version"), F.col("gone"))).alias("v")).select("key", "v.*")
        last = last.persist()
        held = current(spark, folder)
        rows = last.where(~F.col("gone")).drop("gone")
        if held:
            rows = held["keys"].join(last.select("key"), "key", "left_anti").unionByName(rows)
        swap(spark, folder, {"keys": rows}, number)
        last.unpersist()

    return _start(changes, merge, checkpoint, every, once)


def as_messages(table: DataFrame, key: list[str], at: str, version: str) -> DataFrame:
    """Rows of a table, or stream, as messages of newest: their other columns become the value."""
    rest = [c for c in table.columns if c not in {*key, at, version}]
    return table.select(F.to_json(F.struct(*key)).alias("key"), F.col(at).cast("timestamp").alias("feed_ts"), F.col(version).cast("long").alias("version"), F.to_json(F.struct(*rest)).alias("value") if rest else F.lit("{}").alias("value"))

