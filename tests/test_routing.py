"""Routes of many hops against a search of each by itself."""

import heapq
import math
import random

import pytest

from tidewire.operators import routing


def plain(arcs, starts, goals, most, max_turn):
    """Dijkstra from arc to arc."""
    def turns(k, n):
        if max_turn is None:
            return True
        (x1, y1, x2, y2), (u1, v1, u2, v2) = arcs[k][3:], arcs[n][3:]
        a, b = (x2 - x1, y2 - y1), (u2 - u1, v2 - v1)
        return a[0] * b[0] + a[1] * b[1] >= math.hypot(*a) * math.hypot(*b) * (math.cos(math.radians(max_turn)) - 1e-12)

    best, cost, queue = math.inf, {}, [(c, k) for k, c in starts]
    heapq.heapify(queue)
    while queue:
        c, k = heapq.heappop(queue)
        if k in cost:
            continue
        cost[k] = c
        for g, more in goals:
            if arcs[g][0] == arcs[k][1] and turns(k, g):
                best = min(best, c + more)
        for n, arc in arcs.items():
            if arc[0] == arcs[k][1] and turns(k, n):
                heapq.heappush(queue, (c + arc[2], n))
    return best if best <= most else None


@pytest.mark.parametrize("max_turn", [None, 100.0])
def test_routes(spark, max_turn):
    rng = random.Random(6)
    nodes = {i: (49.0 + rng.random() / 50, 11.0 + rng.random() / 50) for i in range(18)}
    edges = [(e, *rng.sample(range(18), 2), rng.choice([100, 130, 200]), rng.choice([0, 0, 1, -1])) for e in range(40)]
    stops = {100 + i: (49.0 + rng.random() / 50, 11.0 + rng.random() / 50) for i in range(8)}
    n = spark.createDataFrame([(i, *p) for i, p in nodes.items()], "id long, lat double, lon double")
    e = spark.createDataFrame(edges, "edge long, a long, b long, cost int, direction int")
    s = spark.createDataFrame([(i, *p) for i, p in stops.items()], "stop long, lat double, lon double")
    ways, ends = routing.arcs(n, e), routing.candidates(s, n, e, 900.0, 2.0)
    hops = [(i, a, b, 6000.0) for i, (a, b) in enumerate((a, b) for a in stops for b in stops if a < b)]
    h = spark.createDataFrame(hops, "hop int, source long, target long, most double")
    got = {r.hop: r for r in routing.routes(h, ends, ways, max_turn).collect()}
    arcs = {r.arc: (r.a, r.b, r.cost, r.x1, r.y1, r.x2, r.y2) for r in ways.collect()}
    by_stop = {}
    for r in ends.collect():
        by_stop.setdefault(r.stop, []).append(r)
    part = lambda r, back: r.t if back else 1 - r.t
    found = 0
    for i, a, b, most in hops:
        starts = [(r.edge * 2 + k, r.cost + part(r, k) * arcs[r.edge * 2 + k][2]) for r in by_stop.get(a, []) for k in (0, 1) if r.edge * 2 + k in arcs]
        goals = [(r.edge * 2 + k, r.cost + (1 - part(r, k)) * arcs[r.edge * 2 + k][2]) for r in by_stop.get(b, []) for k in (0, 1) if r.edge * 2 + k in arcs]
        want = plain(arcs, starts, goals, most, max_turn)
        for r in by_stop.get(a, []):
            for q in by_stop.get(b, []):
                for k in (0, 1):
                    if r.edge == q.edge and r.edge * 2 + k in arcs and part(r, k) >= part(q, k):
                        total = r.cost + q.cost + (part(r, k) - part(q, k)) * arcs[r.edge * 2 + k][2]
                        want = total if total <= most and (want is None or total < want) else want
        assert (want is None) == (got[i].cost is None) and (want is None or abs(got[i].cost - want) < 1e-6), i
        if got[i].path and len(got[i].path) > 1:
            found += 1
            assert all(arcs[x][1] == arcs[y][0] for x, y in zip(got[i].path, got[i].path[1:], strict=False))
    assert found > 5
    rounds, guided = [], []
    plainly = {r.hop: (r.cost, r.path) for r in routing.routes(h, ends, ways, max_turn, report=rounds).collect()}
    headed = {r.hop: (r.cost, r.path) for r in routing.routes(h, ends, ways, max_turn, stops=s, report=guided).collect()}
    assert headed == plainly == {i: (r.cost, r.path) for i, r in got.items()}
    assert sum(n for _, n in guided) < 0.8 * sum(n for _, n in rounds), (guided, rounds)


def test_far_hops_go_by_main_arcs(spark):
    n = spark.createDataFrame([(i, 49.0, 11.0 + i / 100) for i in range(6)] + [(10 + i, 49.01, 11.0 + i / 100) for i in range(6)], "id long, lat double, lon double")
    # a straight byway along the south, and a main road along the north that costs more
    south = [(i, i, i + 1, 100, 0, False) for i in range(5)]
    north = [(20 + i, 10 + i, 11 + i, 150, 0, True) for i in range(5)]
    across = [(40, 0, 10, 100, 0, False), (41, 5, 15, 100, 0, False)]
    e = spark.createDataFrame([*south, *north, *across], "edge long, a long, b long, cost int, direction int, main boolean")
    s = spark.createDataFrame([(1, 49.0, 11.0), (2, 49.0, 11.05)], "stop long, lat double, lon double")
    h = spark.createDataFrame([(7, 1, 2, 50_000.0, True), (8, 1, 2, 50_000.0, False)], "hop int, source long, target long, most double, far boolean")
    ends = routing.candidates(s, n, e, 5.0, 2.0)
    got = {r.hop: [x // 2 for x in r.path] for r in routing.routes(h, ends, routing.arcs(n, e), stops=s, near_m=1200.0).collect()}
    assert got[8] == [0, 1, 2, 3, 4] and [x for x in got[7] if x >= 20] == [40, 20, 21, 22, 23, 24, 41]


def test_ways_beyond_the_network(spark):
    n = spark.createDataFrame([(i, 49.0, 11.0 + i / 100) for i in range(4)], "id long, lat double, lon double")
    e = spark.createDataFrame([(0, 0, 1, 100, 0), (1, 1, 2, 100, 0), (2, 2, 3, 100, 0)], "edge long, a long, b long, cost int, direction int")
    s = spark.createDataFrame([(1, 49.0, 11.0), (2, 49.002, 11.021)], "stop long, lat double, lon double")
    h = spark.createDataFrame([(7, 1, 2, 9000.0)], "hop int, source long, target long, most double")
    ends = routing.candidates(s, n, e, 50.0, 2.0)
    aim = spark.createDataFrame([(2, 11.021 * 111_320 * math.cos(math.radians(49.0)), 49.002 * 111_320)], "stop long, x double, y double")
    (r,) = routing.routes(h, ends, routing.arcs(n, e), None, aim).collect()
    assert (r.path, r.reaches) == ([0, 2], False)
    (r,) = routing.routes(h, ends, routing.arcs(n, e)).collect()
    assert (r.cost, r.path, r.reaches) == (None, None, False)


def test_segments_are_kept_routed_or_straight(spark):
    from tidewire.operators import segments

    nodes = spark.createDataFrame([(i, 49.0, 11.0 + i / 100) for i in range(4)] + [(9, 49.5, 11.5)], "id long, lat double, lon double")
    edges = spark.createDataFrame(
        [("road", 0, 0, 1, 100, 0, True, 10), ("road", 1, 1, 2, 100, 0, True, 20), ("road", 2, 2, 3, 100, 0, True, 10), ("rail", 3, 0, 3, 100, 1, True, None)],
        "net string, edge long, a long, b long, cost int, direction int, main boolean, speed int")
    stops = spark.createDataFrame([(1, 49.0, 11.005), (2, 49.0, 11.025), (3, 49.5, 11.5), (4, 49.0, 11.0)], "stop_id long, lat double, lon double")
    hops = spark.createDataFrame([("road", 1, 2), ("road", 1, 2), ("road", 2, 1), ("road", 1, 3), ("rail", 4, 2), ("rail", 2, 4), ("road", 4, 1), ("road", 4, 2)], "net string, from_id long, to_id long")
    kept = spark.createDataFrame([("road", 4, 1, [(49.0, 11.0, 0.0), (49.1, 11.0, 0.5), (49.0, 11.005, 1.0)]), ("road", 4, 2, None)], f"net string, from_id long, to_id long, points {segments.POINTS}")
    found = {(r.net, r.from_id, r.to_id): (r.state, [(round(p.lat, 6), round(p.lon, 6), round(p.share, 6)) for p in r.points]) for r in segments.build(hops, stops, nodes, edges, kept, radius_m=20.0).collect()}
    assert len(found) == 7
    # half of the first edge, the fast one and half of the last: its twice as long way takes as much as each of the halves
    assert found["road", 1, 2] == ("routed", [(49.0, 11.005, 0.0), (49.0, 11.01, 0.333333), (49.0, 11.02, 0.666667), (49.0, 11.025, 1.0)])
    assert found["road", 2, 1] == ("routed", [(49.0, 11.025, 0.0), (49.0, 11.02, 0.333333), (49.0, 11.01, 0.666667), (49.0, 11.005, 1.0)])
    assert found["road", 1, 3] == ("straight", [(49.0, 11.005, 0.0), (49.5, 11.5, 1.0)])
    assert found["rail", 4, 2] == ("routed", [(49.0, 11.0, 0.0), (49.0, 11.025, 1.0)]) and found["rail", 2, 4][0] == "straight"  # one way only
    assert found["road", 4, 1][0] == "kept" and len(found["road", 4, 1][1]) == 3
    assert found["road", 4, 2] == ("straight", [(49.0, 11.0, 0.0), (49.0, 11.025, 1.0)])
    assert segments.build(hops.where("false"), stops, nodes, edges).count() == 0
