"""Joins, sequences, aggregates, sets and graphs with literal rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.operators import aggregates, frequency, graph, joins, lines, map_view, search, sequences, sets, topk, tracks, vehicles


def every(n, start, end):
    return list(range(start, end, n))


def turns(gaps, start, end):
    out, k = [], 0
    while start < end:
        out.append(start)
        start, k = start + gaps[k % len(gaps)], k + 1
    return out


H = 60
HOURLY = [  # (days of departures, runs)
    ([every(10, 6 * H, 20 * H) + every(20, 20 * H, 23 * H + 41)], [(6, 20, "every", 10, 10), (20, 23, "every", 20, 20)]),
    ([turns([3, 4, 3], 6 * H, 12 * H + 1)], [(6, 12, "atMost", 4, 4)]),
    ([turns([20, 40], 6 * H, 12 * H + 1)], [(6, 12, "perHour", 2, 2)]),
    ([[*every(10, 6 * H, 11 * H + 1), 485]], [(6, 11, "atMost", 10, 10)]),
    ([every(120, 6 * H, 20 * H + 1)], [(6, 20, "every", 120, 120)]),
    ([[360, 410, 470, 520, 580]], [(6, 8, "perHour", 1, 2), (8, 9, "every", 60, 60)]),
    ([[468, 528, 588, 648, 708, 738, 762, 768, 805, 809, 818, 831, 888, 948]], [(8, 12, "every", 60, 60), (12, 14, "perHour", 3, 4), (14, 15, "every", 60, 60)]),
    ([every(20, 497, 538) + every(40, 577, 818) + every(20, 837, 900)], [(9, 13, "every", 40, 40), (13, 14, "every", 20, 20)]),
    ([[*every(20, 497, 538), 577, *every(20, 617, 660)]], [(9, 10, "perHour", 1, 1)]),
    ([[468, 528, 588, 648, 708, 830, 890]], [(8, 12, "every", 60, 60), (12, 13, "none", 0, 0), (13, 14, "every", 60, 60)]),
    ([every(20, 377, 538) + every(40, 577, 758)], [(7, 9, "every", 20, 20), (9, 12, "every", 40, 40)]),
    ([[377, 397, 417, 437, 457, 477, 497, 517, 537, 560, 580, 600, 620, 640]], [(7, 8, "every", 20, 20), (8, 9, "perHour", 3, 3), (9, 10, "every", 20, 20)]),
    ([[*every(20, 377, 558), 630, 660]], [(7, 9, "every", 20, 20), (9, 11, "perHour", 1, 1)]),
    ([[500, 560, 620, 694, 754, 814, 860, 934, 994, 1040, 1100, 1174, 1234]], [(9, 20, "perHour", 1, 1)]),
    ([every(60, 528, 1430)], [(9, 23, "every", 60, 60)]),
    ([[600, 630, 660, 690, 735, 760, 780, 810, 840, 870, 900]], [(10, 12, "every", 30, 30), (12, 13, "perHour", 2, 2), (13, 15, "every", 30, 30)]),
    ([[360, 375, 400, 445, 490, 530, 600]], [(6, 7, "perHour", 3, 3), (7, 9, "perHour", 1, 2), (9, 10, "none", 0, 0)]),
    ([[1300, 1434, 1444, 1454]], [(22, 23, "none", 0, 0), (23, 24, "perHour", 1, 1)]),
    ([[360, 420, 545, 605, 665]], [(6, 8, "every", 60, 60), (8, 9, "none", 0, 0), (9, 11, "every", 60, 60)]),
    ([[360, 420, 480, 540], [360, 400, 540]], [(6, 7, "perHour", 1, 2), (7, 9, "perHour", 0, 1)]),
    ([every(10, 360, 601), every(10, 365, 606)], [(7, 10, "every", 10, 10)]),
    ([every(10, 360, 601), every(12, 360, 601)], [(6, 10, "atMost", 12, 12)]),
    ([every(20, 360, 541), every(30, 360, 541)], [(6, 9, "perHour", 2, 3)]),
    ([every(10, 360, 601), every(10, 480, 721), []], [(8, 10, "every", 10, 10)]),
    ([[*every(10, 360, 481), 400, None]], [(6, 8, "every", 10, 10)]),
    ([[5]], []),
]


def test_hourly_words(spark):
    rows = [(g, day, m) for g, (days, _) in enumerate(HOURLY) for day, ms in enumerate(days) for m in ms]
    df = spark.createDataFrame(rows, "g int, day int, m int")
    got = {}
    for r in frequency.hourly(df, ["g"], "day", "m").collect():
        got.setdefault(r.g, []).append(tuple(r)[1:])
    for g, (_, want) in enumerate(HOURLY):
        assert sorted(got.get(g, [])) == want, g
    assert frequency.hourly(df.where("false"), ["g"], "day", "m").count() == 0


def test_once_an_hour_is_said_one_way(spark):
    def say(lists):
        rows = [(0, g, *r) for g, runs in enumerate(lists) for r in runs]
        df = spark.createDataFrame(rows, "s int, g int, from int, to int, kind string, low int, high int")
        got = [tuple(r) for r in frequency.one_word(df, ["s"], ["s", "g"]).collect()]
        return [sorted(r[2:] for r in got if r[1] == g) for g in range(len(lists))]

    sunday = [(9, 21, "perHour", 1, 1), (21, 22, "none", 0, 0)]
    assert say([[(9, 23, "every", 60, 60)], sunday]) == [[(9, 23, "perHour", 1, 1)], sunday]
    assert say([[(6, 9, "every", 60, 60), (9, 12, "perHour", 1, 1), (12, 14, "every", 30, 30)]]) == [[(6, 12, "perHour", 1, 1), (12, 14, "every", 30, 30)]]
    kept = [[(6, 9, "every", 30, 30), (9, 12, "every", 10, 10)], [(9, 12, "perHour", 2, 2), (12, 14, "every", 20, 20)], [(12, 14, "perHour", 3, 3), (14, 16, "perHour", 0, 1), (16, 18, "every", 60, 60)]]
    assert say(kept) == kept


def test_longest_stretch(spark):
    days = [
        every(10, 360, 1200) + every(20, 1200, 1421),
        turns([3, 4], 300, 540) + turns([7, 6], 540, 720) + turns([3, 4], 720, 1200) + every(12, 1200, 1439),
        [360, 380, 420, 425, 480, 540, 545, 600],
        every(10, 360, 900) + every(30, 900, 1200),
    ]
    df = spark.createDataFrame([(g, 0, m) for g, d in enumerate(days) for m in d], "g int, day int, m int")
    got = {r.g: tuple(r)[1:] for r in frequency.stretches(frequency.hours(df, ["g"], "day", "m"), ["g"]).collect()}
    assert got == {0: (6, 20, "every", 10), 1: (5, 20, "atMost", 7), 3: (6, 15, "every", 10)}


def test_fill_times(spark):
    rows = [("a", 1, 0, 0), ("a", 2, None, None), ("a", 3, None, None), ("a", 4, 100, 110), ("b", 1, None, None), ("b", 2, 5, 5), ("c", 1, None, 7), ("c", 2, 9, None)]
    df = spark.createDataFrame(rows, "t string, p int, arr int, dep int")
    got = [(r.t, r.p, r.arr, r.dep) for r in sequences.fill_times(df, ["t"], "p", "arr", "dep").orderBy("t", "p").collect()]
    assert got == [("a", 1, 0, 0), ("a", 2, 33, 33), ("a", 3, 67, 67), ("a", 4, 100, 110), ("c", 1, 7, 7), ("c", 2, 9, 9)]


def test_carry_forward(spark):
    rows = [(0, 300, None, False), (1, None, None, False), (2, None, 60, False), (3, None, None, True), (4, None, None, False), (5, 30, None, False)]
    df = spark.createDataFrame(rows, "p int, a int, d int, x boolean").withColumn("g", F.lit(1))
    got = [(r.arr_delay, r.dep_delay) for r in sequences.carry_forward(df, ["g"], "p", F.col("a"), F.col("d"), F.col("x")).orderBy("p").collect()]
    assert got == [(300, 300), (300, 300), (300, 60), (None, None), (None, None), (30, 30)]


def test_span_of_day(spark):
    rows = [(1, t) for t in (41 * 60, 5 * 3600, 23 * 3600)] + [(2, 6 * 3600), (2, 22 * 3600)] + [(3, 100)]
    df = spark.createDataFrame(rows, "g int, t int")
    got = {r.g: (r.first, r.last) for r in sequences.span_of_day(df, ["g"], "t").collect()}
    assert got == {1: (23 * 3600, 5 * 3600 + 86400), 2: (22 * 3600, 6 * 3600 + 86400), 3: (100, 100)}


def test_next_other_and_repeats(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5, 5, 6, 6, 5])], "g int, p int, v int")
    assert [r.following for r in sequences.next_other(df, ["g"], "p", "v").orderBy("p").collect()] == [6, 6, 5, 5, None]
    assert [r.p for r in sequences.drop_repeats(df, ["g"], "p", "v").orderBy("p").collect()] == [0, 2, 4]


@pytest.mark.parametrize(("reports", "want"), [
    ([(60, True), (60, False), (120, False)], 60), ([(60, False), (120, False)], 120), ([(None, False)], None), ([(0, False), (0, False), (300, True)], 300), ([(60, True), (120, True)], 120)])
def test_agreed(spark, reports, want):
    df = spark.createDataFrame([(1, d, o) for d, o in reports], "g int, delay int, own boolean")
    assert aggregates.agreed(df, ["g"], "delay", "own").first().agreed == want


def test_merge_near(spark):
    df = spark.createDataFrame([("s", "bus", 49.0, 11.0, 5), ("s", "tram", 49.0001, 11.0, 9), ("s", "ferry", 49.01, 11.0, 1)], "s string, mode string, lat double, lon double, weight int")
    got = sorted((r.place, r.modes) for r in aggregates.merge_near(df, "s").collect())
    assert got == [(0, ["bus", "tram"]), (1, ["ferry"])]


def test_service_dates(spark):
    d = datetime.date
    week = dict.fromkeys(sets.DAYS, 1)
    cal = spark.createDataFrame([("x", d(2026, 10, 1), d(2026, 10, 7), *week.values())], "service_id string, start_date date, end_date date, " + ", ".join(f"{k} int" for k in sets.DAYS))
    ex = spark.createDataFrame([("x", d(2026, 10, 5), 2, 0), ("x", d(2026, 10, 10), 1, 1), ("x", d(2026, 10, 6), 2, 2), ("x", d(2026, 10, 6), 1, 3)], "service_id string, date date, exception_type int, line long")
    assert sorted(r.date.day for r in sets.service_dates(cal, ex).collect()) == [1, 2, 3, 4, 6, 7, 10]


def test_board_falls_back(spark):
    df = spark.createDataFrame([("a", i, i < 3) for i in range(20)] + [("b", i, True) for i in range(20)], "s string, t int, w boolean")
    got = topk.board(df, ["s"], ["t"], "w", limit=12, least=10)
    assert sorted(r.t for r in got.where("s = 'a'").collect()) == list(range(10)) and got.where("s = 'b'").count() == 12


def test_picks_are_apart(spark):
    df = spark.createDataFrame([(1, 9, 49.0, 11.0), (2, 8, 49.001, 11.0), (3, 7, 49.1, 11.0), (4, 1, 49.2, 11.0)], "k int, s int, lat double, lon double")
    assert [r.k for r in topk.picks(df, "k", "s", "lat", "lon", 1000, 3).orderBy("place").collect()] == [1, 3, 4]


def test_components_of_long_chains(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.range(100, 103).select(F.col("id").alias("src"), F.lit(200).cast("long").alias("dst")))
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in (100, 101, 102, 200)) and len(got) == 64
    assert graph.components(edges.where("false")).count() == 0


def plain_ways(runs):
    """{direction: (list, branches)} of one line's runs, call by call."""

    def rank(run):
        return -run[1], -len(run[0]), run[0]

    def place(stops, s):
        return max((i for i, x in enumerate(stops) if x == s), default=None)

    def fold(stops, order, grow):
        """The parts of stops that find no place in order, which grows if it may."""
        loose, part, last = [], [], None
        for s in [*stops, None]:
            if s is not None and s not in order:
                part.append(s)
                continue
            if part:
                a, b = place(order, last), place(order, s)
                at = 0 if a is None and b == 0 else len(order) if b is None and a == len(order) - 1 else b if None not in (a, b) and b > a else None
                if at is None:
                    loose.append(part)
                elif grow:
                    order[at:at] = part
                part = []
            last = s
        return loose

    def merge(mine):
        mine = sorted(mine, key=rank)
        order, loose = list(mine[0][0]), []
        for stops, _ in mine[1:]:
            loose += fold(stops, order, True)
        seen, branches = set(order), []
        for part in loose:
            own = [s for i, s in enumerate(part) if s not in seen and s not in part[:i]]
            seen.update(own)
            branches += [own] if own else []
        return order, branches

    runs = sorted(runs, key=rank)
    main, sides = runs[0][0], ([runs[0]], [], [])
    for stops, n in runs[1:]:
        at = [place(main, s) for s in stops if s in main]
        way = sum((b > a) - (b < a) for a, b in zip(at, at[1:], strict=False))
        sides[2 if way == 0 else 0 if way > 0 else 1].append((stops, n))
    if sides[1]:
        orders = [merge(x)[0] for x in sides[:2]]
        for stops, n in sides[2]:
            costs = []
            for order in orders:
                at = [place(order, s) for s in stops if s in order]
                costs.append(sum(map(len, fold(stops, list(order), False))) + len(order) * sum(b < a for a, b in zip(at, at[1:], strict=False)))
            sides[costs[1] < costs[0]].append((stops, n))
    else:
        sides[0].extend(sides[2])
    return {i: merge(x) for i, x in enumerate(sides[:2]) if x}


def test_ways_of_random_lines(spark):
    import random

    rng = random.Random(4)
    by_line, rows = {}, []
    for line in range(60):
        runs = {}
        base = list(range(7))
        for _ in range(rng.randrange(1, 7)):
            stops = base[:: rng.choice([1, 1, -1])]
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(stops) + 1)
                stops = rng.choice([stops[:i], stops[i:], [*stops[:i], rng.randrange(9), *stops[i:]], [*stops[:i], rng.randrange(10), rng.randrange(10), *stops[i:]]]) or stops
            runs[tuple(stops)] = rng.randrange(1, 6)
        by_line[line] = [(list(s), n) for s, n in runs.items()]
        rows += [(line, list(s), n) for s, n in runs.items()]
    got = {(r.line, r.direction): (r.list, r.branches) for r in lines.ways(spark.createDataFrame(rows, "line int, stops array<long>, trips long"), ["line"]).collect()}
    assert got == {(line, i): way for line, runs in by_line.items() for i, way in plain_ways(runs).items()}


def test_ways_of_lines(spark):
    runs = [([1, 2, 3, 4], 9), ([4, 3, 2, 1], 8), ([1, 2, 5, 3], 2), ([4, 3, 6], 1), ([3, 4], 1), ([1, 7], 1), ([4, 9], 1), ([8, 8], 1)]
    df = spark.createDataFrame([("a", s, t) for s, t in runs] + [("b", [1, 2], 1)], "line string, stops array<long>, trips long")
    got = {(r.line, r.direction): (r.list, sorted(map(list, r.branches))) for r in lines.ways(df, ["line"]).collect()}
    assert got[("b", 0)] == ([1, 2], []) and set(got) == {("a", 0), ("a", 1), ("b", 0)}
    # 1-7 goes on from the end of the way down, 4-9 from that of the way up, 8 is in neither and branches off the way up
    assert got[("a", 0)] == ([1, 2, 5, 3, 4, 9], [[8]]) and got[("a", 1)] == ([4, 3, 2, 1, 7], [[6]])


def test_names_and_places_in_addresses(spark):
    df = spark.createDataFrame([(1, "a", 5, 49.1, 11.0), (2, "a", 7, 49.2, 11.0), (3, "a", 7, 49.1, 11.2), (4, "a", 7, 49.1, 11.1), (5, "b", 0, 0.0, 0.0)], "k int, n string, s int, lat double, lon double")
    assert {r.n: r.k for r in lines.first_of_name(df, "n", "k", "s", "lat", "lon").collect()} == {"a": 4, "b": 5}
    df = spark.createDataFrame([(1, "x", 49.123, 11.0), (2, "x", 49.2, 11.0), (3, "y", 49.1001, 11.0), (4, "y", 49.1002, 11.0), (5, "z", 1.0, 2.0)], "k int, n string, lat double, lon double")
    assert {r.k: r.place for r in lines.places(df, "n", "lat", "lon").collect()} == {1: "49.12,11.00", 2: "49.20,11.00", 3: "49.1001,11.0000", 4: "49.1002,11.0000", 5: None}


def plain_together(rows):
    """Every vehicle against all places so far, in order."""
    import math

    groups, out = [], {}
    for i, x, y, a, near in sorted(rows):
        for f, fx, fy, fa in groups:
            limit = 8 if near == f else 4
            same = a is None and fa is None if a is None or fa is None else math.cos(a - fa) > 0.85
            if abs(x - fx) <= limit and abs(y - fy) <= limit and same:
                out[i] = f
                break
        else:
            groups.append((i, x, y, a))
            out[i] = i
    return out


def test_vehicles_at_one_place(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.uniform(0, 60), rng.uniform(-20, 20), rng.choice([None, 0.0, 0.3, 2.0, 6.2]), rng.choice([None, i - 1, i - 3])) for i in range(150)]
    df = spark.createDataFrame([(1, *r) for r in rows], "s int, id int, x double, y double, heading double, near int")
    assert {r.id: r.first for r in vehicles.together(df, ["s"]).collect()} == plain_together(rows)


def test_kinds_from_tracks(spark):
    stops = {"T1": (49.5002, 11.0), "T2": (49.5002, 11.003), "T3": (49.5002, 11.006), "T4": (49.5002, 11.009), "B1": (49.5002, 11.012), "B2": (49.5002, 11.015), "B3": (49.5002, 11.018),
             "R1": (49.5102, 11.002), "R2": (49.5102, 11.008), "R3": (49.5102, 11.014), "F1": (49.6, 11.0), "F2": (49.6, 11.01)}
    routes = {"TRAM": "T1 T2 T3 T4", "BUS-AS-TRAM": "B1 B2 B3", "TRAM-TRAIN": "R1 R2 R3", "FAR": "F1 F2", "BUS-AS-UBAHN": "B1 B2", "THREE-OF-FIVE": "T1 T2 T3 B1 B2", "TWO-OF-FIVE": "T1 T2 B1 B2 B3"}
    nodes = [(lat, 11.0 + i * 0.001) for lat in (49.5, 49.5103) for i in range(21)]
    rails = [(n, lat, 11.0 + i * 0.001, lat, 11.0 + (i + 1) * 0.001) for n, (lat, i) in enumerate([(49.5001, i) for i in range(10)] + [(49.5101, i) for i in range(20)])]
    s = spark.createDataFrame([(k, *v) for k, v in stops.items()], "stop_id string, lat double, lon double")
    c = spark.createDataFrame([(r, x) for r, xs in routes.items() for x in xs.split()], "route string, stop_id string")
    n, t = spark.createDataFrame(nodes, "lat double, lon double"), spark.createDataFrame(rails, "edge int, lat1 double, lon1 double, lat2 double, lon2 double")
    assert {r.route for r in tracks.kinds_from_tracks(c, s, n, t).collect() if r.is_bus} == {"BUS-AS-TRAM", "BUS-AS-UBAHN", "TWO-OF-FIVE"}
    assert not any(r.is_bus for r in tracks.kinds_from_tracks(c, s, n, t.where("false")).collect())


def test_stab_and_as_of(spark):
    spans = spark.createDataFrame([("a", 0, 7200), ("b", 3600, 3700)], "k string, s int, e int")
    at = spark.createDataFrame([(3590,), (7215,), (9000,)], "t int")
    assert sorted((r.k, r.t) for r in joins.stab(spans, "s", "e", at, "t", 30, 15).collect()) == [("a", 3590), ("a", 7215), ("b", 3590)]
    right = spark.createDataFrame([("a", 1, "x"), ("a", 5, "y")], "k string, since int, v string")
    left = spark.createDataFrame([("a", 0), ("a", 4), ("a", 5), ("b", 5)], "k string, t int")
    assert sorted((r.k, r.t, r.v) for r in joins.as_of(left, right, ["k"], "t", "since", ["v"]).collect() if r.v) == [("a", 4, "x"), ("a", 5, "y")]


def test_polygon_with_hole(spark):
    ring = lambda a, lo, hi: [(a, lo, lo, lo, hi), (a, lo, hi, hi, hi), (a, hi, hi, hi, lo), (a, hi, lo, lo, lo)]
    edges = spark.createDataFrame([*ring(1, 0.0, 1.0), *ring(1, 0.4, 0.6)], "area int, lat1 double, lon1 double, lat2 double, lon2 double")
    points = spark.createDataFrame([(1, 0.2, 0.2), (2, 0.5, 0.5), (3, 2.0, 0.5)], "k int, lat double, lon double")
    assert [r.k for r in joins.point_in_polygon(points, ("lat", "lon"), "k", edges, "area").collect()] == [1]


def test_greedy_match(spark):
    left = spark.createDataFrame([("n", 1, 49.0, 11.0), ("n", 2, 49.1, 11.0)], "g string, left_id long, lat double, lon double")
    right = spark.createDataFrame([("n", 8, 49.09, 11.0), ("n", 9, 49.2, 11.0)], "g string, right_id long, lat double, lon double")
    assert sorted((r.left_id, r.right_id) for r in joins.greedy_match(left, right, "g").collect()) == [(1, 9), (2, 8)]


@pytest.mark.parametrize(("word", "typed", "slips", "want"), [
    ("hauptstrasse", "hauptsrasse", 2, True), ("maehlerei", "mahelerei", 2, True), ("ulm", "ulm", 0, True), ("ulm", "olm", 1, False), ("bahnhof", "bhan", 1, True), ("bahnhof", "bxxx", 1, False)])
def test_near_beginning(word, typed, slips, want):
    assert search.near_beginning(word, typed, slips) == want


def test_search_ladder(spark):
    names = spark.createDataFrame([(1, "Ulm Mählerei", 5), (2, "Mählereistr", 9), (3, "Am Maehlerei", 1), (4, "Hauptbahnhof", 3)], "k int, name string, score int")
    words = search.tokens(names, "k", "name")
    find = lambda q: [(r.k, r.level) for r in search.search_stops(words, names, "k", q, "score").collect()]
    assert find("mählerei") == [(2, 0), (1, 0)] or find("mählerei") == [(2, 0), (1, 0), (3, 2)]
    assert find("hbf") == [(4, 0)] and find("mahtlerei")[0][1] == 2 and find("") == []


def test_thinning_keeps_screens_within_budget(spark):
    v = spark.range(3000).select("id", F.lit("bus").alias("mode"), (F.pmod(F.xxhash64("id"), F.lit(1 << 32))).alias("rank"), (F.lit(49.0) + (F.col("id") % 60) / 300).alias("lat"), (F.lit(11.0) + F.floor(F.col("id") / 60) / 300).alias("lon"))
    shares = map_view.shares(v, budget=300, few=10)
    by_zoom = {r.zoom: r.share for r in shares.collect()}
    assert all(by_zoom[z] <= by_zoom[z + 1] for z in range(5, 11)) and by_zoom[5] < 1
    some, more = (map_view.thin_out(v, shares, z).count() for z in (6, 9))
    assert some <= more <= 3000


def test_global_rank(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"))
    assert all(r.rank == r.k + 1 for r in map_view.global_rank(df, ["k"]).collect())


def test_next_other_is_one_sort(spark):
    df = spark.createDataFrame([(g, i, v) for g, vs in enumerate([[None, 5, None, 5, 6, None, 7], [1, 1], [2]]) for i, v in enumerate(vs)], "g int, p int, v int")
    out = sequences.next_other(df, ["g"], "p", "v")
    assert [r.following for r in out.orderBy("g", "p").collect()] == [None, 6, None, 6, 7, None, None, None, None, None]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_many_runs_have_their_rounds_after_the_first(spark, monkeypatch):
    """The runs of a line in two lots, the first of which has its rounds before the second, make the same ways."""
    import random

    monkeypatch.setattr(lines, "FEW_RUNS", 3)
    rng = random.Random(11)
    by_line, rows = {}, []
    for line in range(12):
        runs = {tuple(rng.sample(range(9), rng.randrange(2, 6))): rng.randrange(1, 5) for _ in range(rng.choice([1, 3, 9]))}
        by_line[line] = [(list(s), n) for s, n in runs.items()]
        rows += [(line, list(s), n) for s, n in runs.items()]
    got = {(r.line, r.direction): (r.list, r.branches) for r in lines.ways(spark.createDataFrame(rows, "line int, stops array<long>, trips long"), ["line"]).collect()}
    assert got == {(line, i): way for line, runs in by_line.items() for i, way in plain_ways(runs).items()}
