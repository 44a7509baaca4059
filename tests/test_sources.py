"""Feeds, live messages, extracts and files built inline."""

import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThanOrEqual, StringContains, StringStartsWith

from tidewire.sources import files, gtfs, gtfs_rt, osm
from tidewire.streaming import realtime

FEED = {
    "agency.txt": "agency_id,agency_name\n1,X\n",
    "stops.txt": "﻿stop_name,parent_station,stop_id,stop_lat,stop_lon,location_type,platform_code\r\n\"A, Markt\",SA,A,49.45,11.05,0,1\r\nStation A,,SA,49.45,11.05,1,\r\nB,,B,49.50,11.10,0,\nC,,C,50.5,12.0,0,\nFar,,F,52.0,13.0,0,\n",
    "routes.txt": "route_long_name,route_short_name,agency_id,route_type,route_id,route_color,route_text_color\n,U1,1,1,R1,,\n,ICE 5,1,2,R2,,\n,36,1,3,R3,,\n",
    "trips.txt": "route_id,service_id,trip_id,trip_headsign\nR1,D,T1,B\nR2,D,T2,\nR3,D,T3,\n",
    "calendar.txt": "monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date,service_id\n1,1,1,1,1,1,1,20261001,20261007,D\n",
    "calendar_dates.txt": "service_id,exception_type,date\nD,2,20261005\nD,1,20261010\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence,stop_headsign,pickup_type,drop_off_type\nT1,10:00:00,10:02:00,A,1,,,\nT1,,,B,2,,,\nT1,10:20:00,10:21:00,C,3,,,\nT2,25:00:00,25:00:00,C,1,,,\nT2,25:30:00,25:30:00,B,2,,,\nT3,08:00:00,08:00:00,F,1,,,\nT3,09:00:00,09:00:00,C,2,,,\n",
}


def test_import_feed(spark, tmp_path):
    path = str(tmp_path / "feed.zip")
    with zipfile.ZipFile(path, "w") as z:
        for name, text in FEED.items():
            z.writestr(name, text)
    t = gtfs.import_feed(spark, path, (49.3, 10.8, 49.7, 11.3))
    assert sorted(r.trip_id for r in t["trips"].collect()) == ["T1", "T2"]
    assert sorted(r.stop_id for r in t["stops"].collect()) == ["A", "B", "C", "SA"]
    assert [r.name for r in t["stops"].where("stop_id = 'A'").collect()] == ["A, Markt"]
    assert [(r.arr_s, r.dep_s) for r in t["stop_times"].where("trip_id = 'T1'").orderBy("stop_seq").collect()] == [(36000, 36120), (36660, 36660), (37200, 37260)]
    assert sorted(r.date.day for r in t["service_dates"].collect()) == [1, 2, 3, 4, 6, 7, 10]
    files.write_dataset(t, str(tmp_path / "data"), "box")
    assert files.read_dataset(spark, str(tmp_path / "data"), "box")["trips"].count() == 2
    assert files.read_dataset(spark, str(tmp_path / "data"), "other") is None


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_name\nA,B\n")
    with pytest.raises(ValueError, match="missing column stop_lat"):
        gtfs.read_table(spark, str(tmp_path), "stops")


def varint(v):
    v &= (1 << 64) - 1
    out = b""
    while v > 0x7F:
        out += bytes([v & 0x7F | 0x80])
        v >>= 7
    return out + bytes([v])


def number(n, v):
    return varint(n << 3) + varint(v)


def data(n, v):
    v = v.encode() if isinstance(v, str) else v
    return varint(n << 3 | 2) + varint(len(v)) + v


def test_live_messages(spark, tmp_path):
    stop = lambda seq, sid, delay: data(2, number(1, seq) + data(4, sid) + data(3, number(1, delay)))
    update = data(3, data(1, data(1, "T1") + data(3, "20261001")) + stop(1, "A", 120) + stop(2, "B", -60))
    alert = data(5, data(1, number(1, 10) + number(2, 20)) + data(5, data(4, data(1, "T1"))) + data(10, data(1, data(1, "closed") + data(2, "en")) + data(1, data(1, "gesperrt") + data(2, "de"))) + number(14, 3))
    message = data(1, data(1, "2.0") + number(3, 1700)) + data(2, data(1, "e1") + update) + data(2, data(1, "e2") + alert)
    (tmp_path / "feed.pb").write_bytes(message)
    rows = gtfs_rt.trip_updates(spark, str(tmp_path / "feed.pb")).orderBy("stop_seq").collect()
    assert [(r.trip_id, r.start_date, r.stop_seq, r.stop_id, r.dep_delay, r.feed_ts) for r in rows] == [("T1", "20261001", 1, "A", 120, 1700), ("T1", "20261001", 2, "B", -60, 1700)]
    assert gtfs_rt.trip_updates(spark, str(tmp_path / "feed.pb"), lambda t: t != "T1").count() == 0
    a = gtfs_rt.alerts(spark, str(tmp_path / "feed.pb")).first()
    assert (a.trip_id, a.title, a.severity, a.warning, a.periods[0].start) == ("T1", "gesperrt", 3, True, 10)


def zz(v):
    return varint((v << 1) ^ (v >> 63))


def pbf(path, nodes, ways, relations, sort=False):
    texts = [""]

    def at(t):
        if t not in texts:
            texts.append(t)
        return texts.index(t)

    def deltas(numbers):
        return b"".join(zz(b - a) for a, b in zip([0, *numbers], numbers, strict=False))

    dense = b"" if not nodes else data(2, data(1, deltas([n[0] for n in nodes])) + data(8, deltas([round(n[1] * 1e7) for n in nodes])) + data(9, deltas([round(n[2] * 1e7) for n in nodes])))
    tags = lambda t: data(2, b"".join(varint(at(k)) for k in t)) + data(3, b"".join(varint(at(v)) for v in t.values()))
    way = b"".join(data(3, number(1, i) + tags(t) + data(8, deltas(refs))) for i, refs, t in ways)
    kinds = {"node": 0, "way": 1, "relation": 2}
    rel = b"".join(data(4, number(1, i) + tags(t) + data(8, b"".join(varint(at(m[2])) for m in ms)) + data(9, deltas([m[1] for m in ms])) + data(10, b"".join(varint(kinds[m[0]]) for m in ms))) for i, t, ms in relations)
    groups = [dense, way, rel]
    block = data(1, b"".join(data(1, t) for t in texts)) + b"".join(data(2, g) for g in groups)
    with open(path, "wb") as f:
        for kind, body in (("OSMHeader", data(5, "Sort.Type_then_ID") if sort else b""), ("OSMData", block)):
            blob = data(3, zlib.compress(body)) + number(2, len(body))
            head = data(1, kind) + number(3, len(blob))
            f.write(struct.pack(">i", len(head)) + head + blob)


def test_extract(spark, tmp_path):
    path = str(tmp_path / "x.osm.pbf")
    square = [(1, 49.0, 11.0), (2, 49.0, 11.2), (3, 49.2, 11.2), (4, 49.2, 11.0), (5, 49.1, 11.1)]
    pbf(path, square, [(10, [1, 2, 3], {"highway": "primary", "oneway": "yes", "maxspeed": "30 mph"}), (11, [3, 4, 1], {}), (12, [5, 99], {"highway": "service"})],
        [(20, {"boundary": "administrative", "name": "Town", "admin_level": "8"}, [("way", 10, "outer"), ("way", 11, "outer")])])
    nodes, edges = osm.networks(spark, path)
    assert sorted((r.net, r.way, r.a, r.b, r.cost, r.direction, r.shared) for r in edges.collect()) == [("road", 10, 1, 2, 100, 1, False), ("road", 10, 2, 3, 100, 1, False)]
    assert {r.id for r in nodes.collect()} >= {1, 2, 3} and {r.speed for r in edges.collect()} == {14}
    assert {r.id for r in osm.read(spark, path, "way").collect()} == {10, 11, 12} and {r.id for r in osm.read(spark, path, "way", ["highway"]).collect()} == {10, 12}
    border = osm.boundaries(spark, path, ["8"])
    from tidewire.operators import joins

    points = spark.createDataFrame([(1, 49.1, 11.1), (2, 49.3, 11.1)], "k int, lat double, lon double")
    assert [r.k for r in joins.point_in_polygon(points, ("lat", "lon"), "k", border, "name").collect()] == [1]


def test_networks_share_tracks_and_end_where_nodes_are_missing(spark, tmp_path):
    path = str(tmp_path / "y.osm.pbf")
    nodes = [(i, 49.0 + i / 100, 11.0) for i in (10, 11, 20, 21, 22, 23)]
    pbf(path, nodes, [(100, [10, 11, 20, 21], {"highway": "residential"}), (101, [10, 11], {"building": "yes"}), (102, [20, 21, 99, 22, 23], {"railway": "tram", "oneway": "yes"}), (103, [10, 22], {"highway": "footway"})], [])
    got = sorted((r.net, r.a, r.b, r.cost, r.direction, r.shared) for r in osm.networks(spark, path)[1].collect())
    assert got == [(net, a, b, cost, 1, shared) for net, cost, shared in (("rail", 150, True),) for a, b in ((20, 21), (22, 23))] + [
        ("road", 10, 11, 130, 0, False), ("road", 11, 20, 130, 0, False), ("road", 20, 21, 130, 0, False)] + [
        (net, a, b, cost, 1, shared) for net, cost, shared in (("subway", 150, True), ("tram", 100, False)) for a, b in ((20, 21), (22, 23))]


def test_blocks_of_other_kinds_are_skipped_unread(tmp_path, monkeypatch):
    path = str(tmp_path / "z.osm.pbf")
    with open(path, "wb") as out:
        parts = [("n", i) for i in range(20)] + [("w", i) for i in range(9)] + [("r", i) for i in range(3)]
        for n, (kind, i) in enumerate(parts):
            one = str(tmp_path / "one")
            pbf(one, [(i, 49.0, 11.0)] if kind == "n" else [], [(i, [1, 2], {"highway": "primary"})] if kind == "w" else [], [(i, {"boundary": "administrative"}, [])] if kind == "r" else [], sort=n == 0)
            raw = open(one, "rb").read()
            out.write(raw if n == 0 else raw[raw.index(b"OSMData") - 6 :])
    spans, is_sorted = osm.blobs(path)
    assert is_sorted and len(spans) == 32
    assert [osm.span_of(path, spans, k) for k in ("node", "way", "relation")] == [spans[:20], spans[20:29], spans[29:]]
    read, plain = [], osm._blob
    monkeypatch.setattr(osm, "_blob", lambda f, at, size: read.append(at) or plain(f, at, size))
    osm.span_of(path, spans, "relation")
    assert len(read) <= 12


def test_filters_reach_the_extract(spark, tmp_path, monkeypatch):
    """Blocks that hold neither the kind nor the ids are not read: all of them are spoilt, and the rows are still right."""
    path = str(tmp_path / "s.osm.pbf")
    parts = [("n", i) for i in range(0, 40, 2)] + [("w", i) for i in range(0, 60, 2)] + [("r", 7)]
    with open(path, "wb") as out:
        for n, (kind, i) in enumerate(parts):
            one = str(tmp_path / "one")
            tags = {"highway": "primary" if i % 4 else "service", "name": f"w{i}"}
            pbf(one, [(i, 49.0, 11.0), (i + 1, 49.0, 11.0)] if kind == "n" else [], [(i, [1, 2], tags), (i + 1, [3, 4], {"railway": "tram"})] if kind == "w" else [], [(i, {"boundary": "administrative"}, [])] if kind == "r" else [], sort=n == 0)
            raw = open(one, "rb").read()
            out.write(raw if n == 0 else raw[raw.index(b"OSMData") - 6 :])
    every = osm.read(spark, path)
    assert {r["kind"]: r["n"] for r in every.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"node": 40, "way": 60, "relation": 1}
    two = every.where("kind = 'node' AND id = 3").unionByName(every.where("kind = 'way' AND id = 4"))
    assert sorted((r.kind, r.id) for r in two.collect()) == [("node", 3), ("way", 4)] and every.count() == 101
    some = osm.read(spark, path, where=[EqualTo(("kind",), "node"), In(("id",), (3, 99))])
    assert [tuple(r) for r in some.select("id", "lat7", "tags").collect()] == [(3, 490000000, None)] and some.where("id = 99").count() == 0
    with pytest.raises(Exception, match="not tested"):
        osm.read(spark, path, where=[IsNotNull(("refs",))]).count()

    spans, _ = osm.blobs(path)
    read, plain = set(), osm._blob
    monkeypatch.setattr(osm, "_blob", lambda f, at, size: read.add(at) or plain(f, at, size))
    found = osm.span_of(path, spans, "way", 21, 24)
    assert found == spans[30:33] and len(read) <= 24
    assert osm.span_of(path, spans, "way", 400, 500) == [] and osm.span_of(path, spans, "node", None, 1) == spans[:1]
    read = set()
    osm.span_of(path, spans, "way", 21, 24)
    raw = bytearray(open(path, "rb").read())
    for at, size in spans:
        if at not in read and (at, size) not in found:
            raw[at : at + size] = b"\xff" * size
    spoilt = str(tmp_path / "spoilt.osm.pbf")
    open(spoilt, "wb").write(raw)
    span = [GreaterThan(("id",), 20), LessThanOrEqual(("id",), 24)]
    right = [(21, (3, 4)), (22, (1, 2)), (23, (3, 4)), (24, (1, 2))]
    for ways in (osm.read(spark, spoilt, "way", where=span), osm.read(spark, spoilt, push=True).where("kind = 'way' AND id > 20 AND id <= 24")):
        assert sorted((r.id, tuple(r.refs)) for r in ways.collect()) == right
    columns = "kind STRING, id BIGINT, highway STRING, name STRING"
    tags = osm.read(spark, spoilt, "way", schema=columns, where=[*span, IsNotNull(("highway",))])
    assert sorted((r.id, r.highway, r.name) for r in tags.collect()) == [(22, "primary", "w22"), (24, "service", "w24")]
    fresh = lambda: osm.read(spark, spoilt, schema=columns, push=True).where("kind = 'way' AND id BETWEEN 21 AND 24")
    assert [r.id for r in fresh().where("highway = 'service' AND name LIKE 'w%'").collect()] == [24]
    assert fresh().where("highway IS NULL").count() == 2
    with pytest.raises(Exception, match="(?i)wire|zlib|error"):
        osm.read(spark, spoilt, "way").count()


def test_what_the_extract_reader_takes(tmp_path):
    reader = osm._Pushed("x", frozenset(osm.ORDER), osm.Wanted(("kind", "id", "highway")))
    rest = [StringContains(("highway",), "a"), IsNotNull(("tags",))]
    assert list(reader.pushFilters([EqualTo(("kind",), "way"), GreaterThan(("id",), 4), In(("id",), (3, 9, 12)), IsNotNull(("id",)), In(("highway",), ("a", None)), *rest])) == rest
    assert reader.kinds == {"way"} and (reader.wanted.low, reader.wanted.high, reader.wanted.ids) == (5, 12, {3, 9, 12}) and reader.wanted.needed == {"highway": {"a"}}
    assert [i for i in range(15) if reader.wanted.has_id(i)] == [9, 12]


def test_filters_reach_live_messages(spark, tmp_path):
    """What is not asked for is not decoded: its stop updates and texts are spoilt."""
    spoilt = varint(2 << 3 | 2) + varint(1) + b"\x07"
    good = lambda t, d: data(3, data(1, data(1, t) + data(3, d)) + data(2, number(1, 1) + data(4, "A") + data(3, number(1, 60))))
    bad = data(3, data(1, data(1, "X9") + data(3, "20261001")) + spoilt)
    alert = lambda t, title: data(5, data(5, data(4, data(1, t))) + data(10, title) + number(14, 3))
    (tmp_path / "in").mkdir()
    for n, trips in enumerate((["T1", "T2"], ["T1", "U1"])):
        body = b"".join(data(2, good(t, f"2026100{n + 1}")) for t in trips) + data(2, bad) + data(2, alert("T1", data(1, data(1, "zu")))) + data(2, alert("X9", b"\x07"))
        (tmp_path / "in" / f"{n}.pb").write_bytes(data(1, number(3, 1700 + n)) + body)
    (tmp_path / "in" / "_none").write_bytes(b"\x07")
    rows = lambda *where: gtfs_rt.trip_updates(spark, str(tmp_path / "in"), where=where)
    got = lambda df: sorted((r.trip_id, r.start_date, r.feed_ts) for r in df.collect())
    first = [("T1", "20261001", 1700), ("T1", "20261002", 1701)]
    assert got(rows(EqualTo(("trip_id",), "T1"))) == first
    assert got(gtfs_rt.trip_updates(spark, str(tmp_path / "in"), push=True).where("trip_id = 'T1' AND dep_delay = 60")) == first
    some = rows(In(("trip_id",), ("T1", "T2", "U1", "Z")))
    assert got(some.where("trip_id = 'T2'").unionByName(some.where("trip_id = 'U1'"))) == [("T2", "20261001", 1700), ("U1", "20261002", 1701)] and some.count() == 4
    assert got(rows(StringStartsWith(("trip_id",), "T"), EqualTo(("start_date",), "20261001"))) == [("T1", "20261001", 1700), ("T2", "20261001", 1700)]
    assert got(gtfs_rt.trip_updates(spark, str(tmp_path / "in" / "1*.pb"), where=[EqualTo(("trip_id",), "U1")])) == [("U1", "20261002", 1701)]
    assert [(r.title, r.warning) for r in gtfs_rt.alerts(spark, str(tmp_path / "in"), where=[EqualTo(("trip_id",), "T1")]).where("stop_id IS NULL").collect()] == [("zu", True)] * 2
    for bad_where in ([], [GreaterThanOrEqual(("dep_delay",), 60)]):
        with pytest.raises(Exception, match="wire type|not tested"):
            rows(*bad_where).count()


def test_geojson(spark, tmp_path):
    ring = [[11.0, 49.0], [11.2, 49.0], [11.2, 49.2], [11.0, 49.0]]
    doc = {"type": "FeatureCollection", "features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    edges = files.polygon_edges(spark, str(tmp_path / "a.json"))
    assert edges.count() == 9 and edges.select("area").distinct().count() == 3


def test_log(spark, tmp_path):
    rows = lambda r: spark.createDataFrame(r, "k string, v int, n int").withColumn("n", F.col("n"))
    log = str(tmp_path / "log")
    files.append_log(rows([("a", 1, 1), ("b", 1, 1)]), log)
    files.append_log(rows([("a", 2, 2)]), log)
    keep = spark.createDataFrame([("a",)], "k string")
    files.compact_log(spark, log, str(tmp_path / "new"), ["k"], "n", keep)
    assert [(r.k, r.v) for r in spark.read.parquet(str(tmp_path / "new")).collect()] == [("a", 2)]


def test_stream_replaces_the_state(spark, tmp_path):
    one = spark.sql("SELECT 1L AS trip_id, DATE'2026-10-01' AS service_date, p AS pos, 'SCHEDULED' AS kind, d AS delay, TIMESTAMP'2026-10-01 10:00:00' AS feed_ts FROM VALUES (0, 60), (1, CAST(NULL AS INT)) AS t(p, d)")
    two = spark.sql("SELECT 2L AS trip_id, DATE'2026-10-01' AS service_date, 0 AS pos, 'SCHEDULED' AS kind, 30 AS delay, TIMESTAMP'2026-10-01 10:01:00' AS feed_ts")
    folder = str(tmp_path / "in")
    for df in (one, two):
        df.coalesce(1).write.mode("append").parquet(folder)
        realtime.keep_current(realtime.read_updates(spark, folder), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination()
        state = realtime.current(spark, str(tmp_path / "out"))["delays"]
        if df is one:
            assert [(r.pos, r.dep_delay) for r in state.orderBy("pos").collect()] == [(0, 60), (1, 60)]
    state = realtime.current(spark, str(tmp_path / "out"))["delays"]
    assert [(r.trip_id, r.dep_delay) for r in state.collect()] == [(2, 30)]
    assert realtime.fresh(state, "2026-10-01 10:03:00").count() == 1 and realtime.fresh(state, "2026-10-01 10:05:00").count() == 0
