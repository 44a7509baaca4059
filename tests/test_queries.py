"""Every query with SQL gives the SQL's rows on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def names():
    from tidewire.plans import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", names())
def test_query_equals_sql(spark, duck, name):
    from tidewire.plans import QUERIES, SQL

    got = QUERIES[name](spark, SF)
    order = sorted(got.columns)
    result = duck.execute(SQL[name])
    at = [d[0] for d in result.description]
    assert sorted(at) == order
    want = sorted(str([plain(r[at.index(c)]) for c in order]) for r in result.fetchall())
    assert sorted(str([plain(r[c]) for c in order]) for r in got.collect()) == want


def test_ways_of_all_lines(spark):
    from collections import defaultdict

    from tidewire.plans import QUERIES
    from tidewire.plans.relational import LINE, _line_runs

    from .test_operators import plain_ways

    by_line = defaultdict(list)
    for r in _line_runs(spark, SF).collect():
        by_line[tuple(r[c] for c in LINE)].append((list(r.stops), r.trips))
    want = {(*line, i): way for line, runs in by_line.items() for i, way in plain_ways(runs).items()}
    got = {(*[r[c] for c in LINE], r.direction): (r.list, r.branches) for r in QUERIES["q16_line_ways"](spark, SF).collect()}
    assert got == want and len(want) > 20


def test_vehicles_of_all_screens(spark):
    from collections import defaultdict

    from tidewire.plans import QUERIES
    from tidewire.plans.more_queries import _screens

    from .test_operators import plain_together

    rows = defaultdict(list)
    for r in _screens(spark, SF).select("screen", "id", "x", "y", "heading", "near").collect():
        rows[r.screen].append(tuple(r)[1:])
    got = {r.id: r.first for r in QUERIES["q42_vehicles_together"](spark, SF).collect()}
    assert got == {i: f for mine in rows.values() for i, f in plain_together(mine).items()} and len(set(got.values())) < len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_two_moments_are_one_sort(spark):
    from tidewire.plans import QUERIES

    plan = QUERIES["m12_lite_two_moments"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1 and "Union" not in plan
