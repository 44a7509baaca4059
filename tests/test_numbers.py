"""Numbers of stations that are named alike, over several imports."""

import math
import random

from tidewire.operators import numbers

SCHEMA = "id long, name string, service double, lat double, lon double"


def run(spark, stations, kept):
    found, entries = numbers.numbered(spark.createDataFrame(stations, SCHEMA), spark.createDataFrame(kept, "name string, lat double, lon double, number int"))
    return {r.id: r.number for r in found.collect()}, sorted(tuple(r) for r in entries.select("name", "lat", "lon", "number").collect())


def test_numbers_are_kept_moved_and_freed(spark):
    first = [(1, "a", 5.0, 49.0, 11.0), (2, "a", 9.0, 49.1, 11.0), (3, "a", 1.0, 49.2, 11.0), (4, "b", 1.0, 49.0, 11.0)]
    got, entries = run(spark, first, [])
    assert got == {1: 2, 2: 1, 3: 3, 4: 0} and entries == [("a", 49.0, 11.0, 2), ("a", 49.1, 11.0, 1), ("a", 49.2, 11.0, 3)]  # the busiest first, then from the south
    # 2 is gone, 3 has moved by 200 m, 5 is new, and b has a second stop
    second = [(1, "a", 5.0, 49.0, 11.0), (3, "a", 99.0, 49.2018, 11.0), (5, "a", 50.0, 48.0, 11.0), (4, "b", 1.0, 49.0, 11.0), (6, "b", 2.0, 49.0, 11.5)]
    got, entries = run(spark, second, entries)
    assert got == {1: 2, 3: 3, 5: 4, 6: 1, 4: 2}
    assert ("a", 49.1, 11.0, 1) in entries and ("a", 49.2018, 11.0, 3) in entries and len(entries) == 6
    # 2 comes back, under another id, and gets its own number again; 1 has moved too far
    got, _ = run(spark, [(7, "a", 0.0, 49.1001, 11.0), (1, "a", 5.0, 49.01, 11.0), (4, "b", 1.0, 49.0, 11.0)], entries)
    assert got == {7: 1, 1: 5, 4: 2}


def test_nearest_first_is_the_greedy_one(spark):
    rng = random.Random(3)
    pairs = list({(rng.randrange(40), rng.randrange(40)): None for _ in range(300)})
    rows = [(a, b, rng.randrange(12)) for a, b in pairs]
    want, left, right = set(), set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in rows):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    from pyspark.sql import functions as F

    got = numbers.nearest_first(spark.createDataFrame(rows, "a int, b int, d int"), "a", "b", [F.col("d")])
    assert {(r.a, r.b) for r in got.collect()} == want and math.isclose(len(want), got.count())


def test_towns_after_names(spark):
    stations = [(1, "markt", 1, 9.0, 1.0, 1.0), (2, "markt", 2, 1.0, 1.0, 1.0), (3, "markt", 3, 1.0, 1.0, 1.0), (4, "markt", None, 1.0, 1.0, 1.0), (5, "markt", 1, 1.0, 1.0, 1.0), (6, "park", 2, 1.0, 1.0, 1.0), (7, "markt", 4, 1.0, 1.0, 1.0)]
    towns = [(1, "neustadt", "ost"), (2, "berg", "west"), (3, "neustadt", "sued"), (4, "tal", None)]
    got = numbers.with_towns(spark.createDataFrame(stations, "id int, name string, town_id int, service double, lat double, lon double"), spark.createDataFrame(towns, "town_id int, town string, district string"))
    assert {r.id: r.address for r in got.collect()} == {1: "markt", 2: "markt-berg", 3: "markt-sued", 4: "markt", 5: "markt", 6: "park", 7: "markt-tal"}


def test_kept_numbers_without_all_pairs(spark):
    """Rings and places give what the greedy order over all pairs gives, on places with many stations, mirrored places and a number with two places."""
    from pyspark.sql import functions as F

    from tidewire.functions import geo

    rng = random.Random(8)
    spots = [(49.0 + rng.randrange(12) / 2000, 11.0 + rng.randrange(12) / 2000) for _ in range(25)] + [(0.001, 0.0), (-0.001, 0.0), (0.0, 0.001), (0.0, -0.001), (0.0, 0.0)]
    stations = [(i, rng.choice("ab"), 0.0, *rng.choice(spots)) for i in range(160)] + [(900 + i, "n", 0.0, 49.0, 11.0) for i in range(30)]
    kept = [(rng.choice("ab"), *rng.choice(spots), i) for i in range(140)] + [("n", 49.0, 11.0, i) for i in range(20)] + [("a", *rng.choice(spots), 7) for _ in range(3)]
    k = spark.createDataFrame(list(dict.fromkeys(kept)), "name string, _lat double, _lon double, number int").withColumn("_e", F.xxhash64("name", "number"))
    s = spark.createDataFrame(stations, SCHEMA)
    pairs = s.join(k, "name").withColumn("away", geo.metres(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))).where(f"away <= {numbers.KEPT_M}")
    want, left, right = set(), set(), set()
    for _, number, i, e in sorted((r.away, r.number, r.id, r._e) for r in pairs.collect()):
        if i not in left and e not in right:
            want.add((i, e, number))
            left.add(i)
            right.add(e)
    found = [tuple(r) for r in numbers.nearest_kept(s, k).collect()]
    assert set(found) == want and len(found) == len(want) > 100


def test_stations_of_one_place_pair_at_once(spark, monkeypatch):
    """Many stations and numbers of one place: as many pairs as rows, where all pairs would be their product."""
    made = []
    plain = numbers.materialise

    def spy(df, name):
        made.append((name, plain(df, name)))
        return made[-1][1]

    monkeypatch.setattr(numbers, "materialise", spy)
    stations = spark.range(400).selectExpr("id", "'n' AS name", "0e0 AS service", "49e0 AS lat", "11e0 AS lon")
    kept = spark.range(300).selectExpr("'n' AS name", "49e0 AS lat", "11e0 AS lon", "CAST(id + 1 AS INT) AS number")
    found, _ = numbers.numbered(stations, kept)
    assert {r.id: r.number for r in found.collect()} == {i: i + 1 for i in range(400)}
    assert sum(name == "taken" for name, _ in made) == 1
