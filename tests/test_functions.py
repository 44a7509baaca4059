"""Scalar functions with literal values."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import geo, hashing, realtime, text, time


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


@pytest.mark.parametrize(("given", "want"), [
    ("Garten- _halle", "Gartenhalle"), ("Altstadt-\\nIndustriehof", "Altstadt-Industriehof"), ("A_B\\tC  d ", "A B C d"), ("Ulm - _Süd", "Ulm - Süd")])
def test_tidy_name(spark, given, want):
    assert one(spark, x=text.tidy_name(F.lit(given))).x == want


@pytest.mark.parametrize(("given", "want"), [("München Süd", "muenchen-sued"), ("Ærø Łódź", "aero-lodz"), ("--", "-"), ("Straße 5", "strasse-5"), ("Café à é", "cafe-a-e")])
def test_slug(spark, given, want):
    assert one(spark, x=text.slug(F.lit(given))).x == want


def test_fold_and_words(spark):
    r = one(spark, f=text.fold(F.lit("Müller Straße é")), w=text.folded_words(F.lit("Berg(Saale)Bf")), c=text.compact(F.lit("RE 10")))
    assert (r.f, r.w, r.c) == ("muller strasse e", ["berg", "saale", "bf"], "re10")


@pytest.mark.parametrize(("name", "town", "want"), [
    ("Rathausplatz", "München", "München"), ("Lübeck Süd", "Lübeck", None), ("Neustadt (Aisch) Markt", "Neustadt an der Aisch", None), ("Lübecker Straße", "Lübeck", "Lübeck"), ("Markt", None, None)])
def test_town_to_show(spark, name, town, want):
    assert one(spark, x=text.town_to_show(F.lit(name), F.lit(town).cast("string"))).x == want


@pytest.mark.parametrize(("given", "want"), [("90A714 Nordbahn AG", "Nordbahn AG"), ("xyz22E Bahn", "Bahn"), ("Linien GmbH", "Linien GmbH"), ("907714", "907714")])
def test_operator_name(spark, given, want):
    assert one(spark, x=text.operator_name(F.lit(given))).x == want


def test_addresses(spark):
    parse = lambda s: one(spark, x=text.parse_address(F.lit(s))).x
    stop = parse("stop/ulm-hbf/2")
    assert (stop.type, stop.name, stop.number) == ("stop", "ulm-hbf", 2)
    line = parse("line/abc/tram/4@49.45,11.08")
    assert (line.agency, line.mode, line.name, line.lat, line.lon) == ("abc", "tram", "4", 49.45, 11.08)
    trip = parse("trip/db/regional/re-10/2026-10-01/0915-ulm-hbf")
    assert (trip.day, trip.time, trip.start) == ("2026-10-01", "0915", "ulm-hbf")
    assert parse("line/abc/zeppelin/4") is None and parse("stop/a@95,10") is None and parse("x") is None
    r = one(spark, s=text.stop_path(F.lit("a"), F.lit(2)), p=text.stop_path_at(F.lit("Ä b"), F.lit(49.12345), F.lit(11.0)))
    assert (r.s, r.p) == ("stop/a/2", "stop/ae-b@49.1235,11.0000") or (r.s, r.p) == ("stop/a/2", "stop/ae-b@49.1234,11.0000")


@pytest.mark.parametrize(("kind", "name", "want"), [
    (0, "4", "tram"), (0, "U1", "subway"), (1, "", "subway"), (2, "S1", "suburban"), (2, "ICE 29", "longdistance"), (2, "RE 1", "regional"), (3, "", "bus"), (4, "", "ferry"), (7, "", "cable"), (700, "", "other"), (1400, "", "cable"), (1000, "", "ferry")])
def test_route_mode(spark, kind, name, want):
    assert one(spark, x=text.route_mode(F.lit(kind), F.lit(name))).x == want


def test_choice(spark):
    r = one(spark, k=text.read_choice(F.lit(" Tram/4,bus/36~ulm,tram/4,x/1,bus/")), none=text.read_choice(F.lit(None).cast("string")))
    assert r.k == ["tram/4", "bus/36~ulm"] and r.none == []
    keys = lambda *k: F.array(*[F.lit(x) for x in k]).cast("array<string>")
    every = keys("tram/4~a", "tram/4~b")
    tap = lambda chosen: one(spark, x=text.toggled(chosen, F.lit("tram/4~a"), every)).x
    assert tap(keys()) == ["tram/4~a"] and tap(keys("tram/4")) == ["tram/4~b"] and tap(keys("bus/1")) == ["bus/1", "tram/4~a"] and tap(keys("tram/4~a", "bus/1")) == ["bus/1"]


def test_versions_and_addresses(spark):
    r = one(spark, a=text.is_newer(F.lit("v1.10.0"), F.lit("1.9.9")), b=text.is_newer(F.lit("x"), F.lit("1.0.0")), c=text.short_ip(F.lit("1.2.3.4")), d=text.short_ip(F.lit("2001:db8:1:2::3")))
    assert (r.a, r.b, r.c, r.d) == (True, False, "1.2.3.0", "2001:db8:1::")


def test_service_day_begins_twelve_hours_before_noon(spark):
    day = F.lit("2026-10-25").cast("date")
    r = one(spark, s=time.service_day_start(day), d=time.local_date(F.lit(1792882800)), c=time.local_clock(F.lit(1792882800)), p=time.parse_time(F.lit("25:30:00")), n=time.parse_time(F.lit("")), w=time.weekday(day))
    assert (r.s, r.d, r.c, r.p, r.n, r.w) == (1792882800, datetime.date(2026, 10, 25), "0100", 91800, None, 6)


def test_geo(spark):
    r = one(spark, a=geo.half_up(F.lit(-2.5)), b=geo.half_up(F.lit(2.5)), m=geo.metres(F.lit(49.0), F.lit(11.0), F.lit(49.001), F.lit(11.0)), e=geo.bearing(F.lit(49.0), F.lit(11.0), F.lit(49.0), F.lit(11.1)))
    assert (r.a, r.b, round(r.m, 2), r.e) == (-2, 3, 111.32, 90)


def test_hilbert_steps_are_neighbours(spark):
    rows = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    got = rows.select("x", "y", geo.hilbert(F.col("x"), F.col("y"), 4).alias("k")).orderBy("k").collect()
    assert [r.k for r in got] == list(range(256))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(got, got[1:], strict=False))


def test_mix_is_the_finaliser(spark):
    def plain(h):
        h ^= h >> 16
        h = h * hashing.M1 & hashing.MASK
        h ^= h >> 13
        h = h * hashing.M2 & hashing.MASK
        return h ^ h >> 16

    values = [0, 1, 2, 12345, 2**31, 2**32 - 1]
    got = {r.v: r.m for r in spark.createDataFrame([(v,) for v in values], "v long").select("v", hashing.mix(F.col("v")).alias("m")).collect()}
    assert got == {v: plain(v) for v in values}


@pytest.mark.parametrize(("delay", "want"), [(None, "none"), (-90, "early"), (-29, "ok"), (89, "ok"), (90, "minor"), (269, "minor"), (270, "major"), (570, "severe")])
def test_delay_class(spark, delay, want):
    assert one(spark, x=realtime.delay_class(F.lit(delay).cast("int"))).x == want


def test_event_delay(spark):
    n = F.lit(None).cast("long")
    r = one(spark, a=realtime.event_delay(F.lit(1060), F.lit(5), F.lit(1000)), b=realtime.event_delay(n, F.lit(5), F.lit(1000)), c=realtime.event_delay(F.lit(90000), F.lit(5), F.lit(1000)))
    assert (r.a, r.b, r.c) == (60, 5, None)
