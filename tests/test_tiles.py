"""Parts of networks against the rule said plainly."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import tiles


@pytest.fixture(scope="module")
def network():
    rng = random.Random(7)
    nodes = [(i, 48.9 + rng.random() * 0.5, -0.2 + rng.random() * 0.5) for i in range(120)] + [(500, None, 1.0)]
    edges = [(rng.randrange(120), rng.randrange(120), n) for n in range(150)] + [(3, 999, 900), (3, 500, 901), (5, 5, 902), (7, 8, 903), (7, 8, 904)]
    return nodes, edges


def home(lat, lon, size):
    return int(lat // size), int(lon // size)


@pytest.mark.parametrize("reach", [0, 1])
def test_parts_stand_on_their_own(spark, network, reach):
    nodes, edges = network
    size = 0.1
    n = spark.createDataFrame(nodes, "id long, lat double, lon double").withColumn("tag", F.col("id") * 2)
    e = spark.createDataFrame(edges, "a long, b long, edge int")
    part_nodes, part_edges = tiles.parts(n, e, size, reach)
    at = {i: home(lat, lon, size) for i, lat, lon in nodes if lat is not None}
    near = lambda t, i: max(abs(t[0] - at[i][0]), abs(t[1] - at[i][1])) <= reach
    whole = [(a, b, k) for a, b, k in edges if a in at and b in at]
    windows = {(y + dy, x + dx) for y, x in at.values() for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)}
    want_edges = sorted((t, a, b, k) for t in windows for a, b, k in whole if near(t, a) or near(t, b))
    got_edges = sorted(((r.ty, r.tx), r.a, r.b, r.edge) for r in part_edges.collect())
    assert got_edges == want_edges
    members = {(t, i) for t in windows for i in at if near(t, i)} | {(t, i) for t, a, b, _ in want_edges for i in (a, b)}
    got = part_nodes.collect()
    assert sorted(((r.ty, r.tx), r.id) for r in got) == sorted(members) and part_nodes.columns == ["ty", "tx", "id", "lat", "lon", "tag", "home", "border"]
    for r in got:
        assert r.home == (at[r.id] == (r.ty, r.tx)) and r.border == (not near((r.ty, r.tx), r.id)) and r.tag == 2 * r.id
    assert sorted(r.id for r in got if r.home) == sorted(at)  # every node once
    assert {x[1:] for x in got_edges} == set(whole)  # together all edges
    mine = {}
    for t, a, b, k in got_edges:
        mine.setdefault(t, set()).add((a, b, k))
    for r in got:  # a node off the border has all its edges
        if not r.border:
            assert {x for x in whole if r.id in x[:2]} <= mine.get((r.ty, r.tx), set())


def test_part_by_condition(spark, network):
    nodes, edges = network
    n, e = spark.createDataFrame(nodes, "id long, lat double, lon double"), spark.createDataFrame(edges, "a long, b long, edge int")
    found, kept = tiles.part_of(n, e, F.col("lat") < 49.1)
    known = {i for i, _, _ in nodes}
    inside = {i for i, lat, _ in nodes if lat is not None and lat < 49.1}
    want = [x for x in edges if x[0] in known and x[1] in known and (x[0] in inside or x[1] in inside)]
    assert sorted(tuple(r) for r in kept.collect()) == sorted(want)
    assert {r.id: r.border for r in found.collect()} == {i: i not in inside for i in inside | {i for x in want for i in x[:2]}}


def test_no_nodes_and_no_edges(spark):
    n, e = spark.createDataFrame([], "id long, lat double, lon double"), spark.createDataFrame([], "a long, b long")
    assert [df.count() for df in (*tiles.parts(n, e, 0.1), *tiles.part_of(n, e, F.lit(True)))] == [0, 0, 0, 0]
    one = spark.createDataFrame([(1, 49.0, 11.0)], "id long, lat double, lon double")
    found = tiles.parts(one, e, 0.1)[0].collect()
    assert len(found) == 9 and [(r.ty, r.tx) for r in found if r.home] == [(490, 110)] and not any(r.border for r in found)
