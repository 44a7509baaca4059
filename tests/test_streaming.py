"""Streams with state: swaps that readers never meet half-done, keyed state with age, and live messages as one query."""

import datetime as dt

from pyspark.sql import functions as F

from tidewire.streaming import realtime

from .test_sources import data, number


def test_readers_see_whole_versions_only(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert realtime.current(spark, folder) is None
    realtime.swap(spark, folder, {"a": spark.range(3), "b": spark.range(5)}, 0)
    reader = realtime.current(spark, folder)
    # the next version half-written, as a reader may meet it: a table, but no head
    spark.range(7).write.parquet(f"{folder}/v={1:012d}/a")
    assert realtime.versions(spark, folder) == [0] and realtime.current(spark, folder)["a"].count() == 3
    seen = []

    class Watch(dict):
        def items(self):
            for name, df in super().items():
                seen.append((realtime.current(spark, folder)["a"].count(), realtime.current(spark, folder)["b"].count()))
                yield name, df

    realtime.swap(spark, folder, Watch(a=spark.range(7), b=spark.range(9)), 1)  # a reader asks before each table of the swap
    assert seen == [(3, 5), (3, 5)]
    assert realtime.current(spark, folder)["b"].count() == 9 and reader["a"].count() == 3 and reader["b"].count() == 5
    for n in range(2, 6):
        realtime.swap(spark, folder, {"a": spark.range(n), "b": spark.range(n)}, n, kept=2)
    assert realtime.versions(spark, folder) == [4, 5]
    realtime.swap(spark, folder, {"a": spark.range(1), "b": spark.range(1)}, 5, kept=2)  # a batch that is run again
    assert realtime.current(spark, folder)["a"].count() == 1


def test_keyed_state_ages_and_takes_the_newest(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 10, 1, 10) + dt.timedelta(seconds=s)
    schema = "key string, feed_ts timestamp, version long, value string"
    batches = [
        [("a", at(0), 1, "a1"), ("b", at(0), 1, "b1"), ("a", at(0), 1, "a1")],
        [("a", at(50), 2, "a2"), ("a", at(40), 9, "late"), ("c", at(60), 1, "c1")],
        [("a", at(50), 2, "a2"), ("a", at(49), 3, "late"), ("c", at(60), 0, "older version")],
        [("d", at(200), 1, "d1")],  # b is 200 s old, over its 180
        [("b", at(205), 2, "b2"), ("c", at(10), 5, "stale")],
    ]
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    got = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withWatermark("feed_ts", "0 seconds")
        with realtime.rocks(spark):
            realtime.keep_keys(realtime.newest(stream, 180), state, str(tmp_path / "check"), once=True).awaitTermination()
        got.append({r.key: r.value for r in realtime.current(spark, state)["keys"].collect()})
        assert n > 2 or got[-1].keys() >= {"a", "b"}
    assert got == [{"a": "a1", "b": "b1"}, {"a": "a2", "b": "b1", "c": "c1"}, {"a": "a2", "b": "b1", "c": "c1"}, {"a": "a2", "c": "c1", "d": "d1"}, {"a": "a2", "b": "b2", "c": "c1", "d": "d1"}]


def test_live_messages_as_one_query(spark, tmp_path):
    stop = lambda seq, delay: data(2, number(1, seq) + data(3, number(1, delay)))
    update = lambda trip, *stops: data(2, data(1, trip) + data(3, data(1, data(1, trip) + data(3, "20261001")) + b"".join(stops)))
    alert = lambda trip, text, start, severity: data(2, data(1, text) + data(5, data(1, number(1, start)) + data(5, data(4, data(1, trip))) + data(10, data(1, data(1, text) + data(2, "de"))) + number(14, severity)))
    message = lambda at, *parts: data(1, data(1, "2.0") + number(3, at)) + b"".join(parts)
    (tmp_path / "in").mkdir()
    trips = spark.createDataFrame([("T1",), ("T2",), ("T3",)], "trip_id string")
    hops = spark.createDataFrame([(t, p, f"s{p}", f"s{p + 1}") for t in ("T1", "T2") for p in range(3)] + [("T3", 0, "x", "y")], "trip_id string, pos int, from_id string, to_id string")

    def run():
        realtime.keep_live(realtime.read_messages(spark, str(tmp_path / "in")), trips, hops, str(tmp_path / "out"), str(tmp_path / "check"), lambda: 1000, once=True).awaitTermination()
        out = realtime.current(spark, str(tmp_path / "out"))
        delays = {(r.trip_id, r.pos): r.delay for r in out["delays"].collect()}
        return delays, sorted((r.trip_id, r.title, r.warning) for r in out["notes"].collect()), tuple(out["status"].select("feed_ts", "matched").first())

    (tmp_path / "in" / "1.pb").write_bytes(message(1000, update("T1", stop(0, 120)), update("T2", stop(1, 60)), update("NO", stop(1, 60)), alert("T1", "closed", 0, 3), alert("T1", "closed", 0, 3), alert("T2", "later", 2000, 1)))
    delays, notes, status = run()
    assert status == (1000, 2) and notes == [("T1", "closed", True)]
    # T1 alone reports on the first hop; on the others both have a delay, and the larger of the equally frequent is agreed on
    assert delays == {("T1", 0): 120, ("T2", 0): 120, **{(t, p): 120 for t in ("T1", "T2") for p in (1, 2)}}
    (tmp_path / "in" / "2.pb").write_bytes(message(900, update("T3", stop(0, 600))))  # an older message that comes late
    assert run() == (delays, notes, status)
    (tmp_path / "in" / "3.pb").write_bytes(message(1060, update("T3", stop(0, 600))))
    assert run() == ({("T3", 0): 600}, [], (1060, 1))


def test_state_that_never_ages_needs_no_python(spark, tmp_path):
    at = lambda s: dt.datetime(2026, 10, 1, 10) + dt.timedelta(seconds=s)
    schema = "key string, feed_ts timestamp, version long, value string"
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    batches = [
        [("a", at(0), 1, "a1"), ("a", at(0), 1, "a1"), ("b", at(9), 1, "b1")],
        [("a", at(9000), 1, "a2"), ("b", at(9), 0, "older version"), ("b", at(8), 7, "late")],
        [("a", at(50), 3, "late"), ("c", at(-90_000), 1, "long past"), ("b", at(9), 2, "b2")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        changes = realtime.newest(spark.readStream.schema(schema).parquet(source).withWatermark("feed_ts", "0 seconds"), None)
        with realtime.rocks(spark):
            query = realtime.keep_keys(changes, state, str(tmp_path / "check"), once=True)
            query.awaitTermination()
        plan = query._jsq.lastProgress().prettyJson()
        assert '"operatorName" : "stateStoreSave"' in plan and "transformWithState" not in plan
    assert {r.key: r.value for r in realtime.current(spark, state)["keys"].collect()} == {"a": "a2", "b": "b2", "c": "long past"}
